"""Benchmark decontamination by winnowing.

Of every run of ``w`` consecutive k-gram hashes the smallest one (the rightmost
of equal ones) is a fingerprint.  Two texts that share ``k + w - 1`` words share
a whole run, hence the same fingerprint at the same place in it: with k = 5 and
spans of 10 words no shared span is missed.  Training and test fingerprints are
joined on their hash, each extended by the words around its k-gram to every span
that holds it; a hit counts when a whole span is equal word by word, and equal
spans that overlap or follow each other merge into the shared run.

Items shorter than a span are one span each, so every item length below 10 that
occurs gets a fingerprint class of its own, with ``k = min(5, length)``.

The documents are read once.  A fixed-size bit set of the test fingerprints
(bounded whatever the benchmark's size) drops most other fingerprints before the
join; it only lets too much through, never too little.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored
from .textbytes import Chunk, LOWER, id_and_text, mix, per_document, runs, text_chunks, word_hashes

SPAN = 10
GRAM = 5
#: log2 of the bits in the pre-join filter (2 MiB).
FILTER_BITS = 24

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = True
_WORD[0x61:0x7B] = True
_WORD[0x80:] = True

_HIT = "struct<span:int,gram:long,at:long,words:array<long>>"


def chunk_words(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a chunk and each document's first word index."""
    data = LOWER[chunk.data]
    starts, ends = runs(_WORD[data], chunk.offsets)
    hashes = word_hashes(data, starts, ends) | np.uint64(2)      # never 0 or 1, see _around
    return hashes, per_document(starts, chunk.offsets)


def gram_size(span: int) -> int:
    return min(GRAM, span)


def fingerprints(words: np.ndarray, first: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and k-gram hashes winnowed for shared spans of ``span`` words.

    ``first[i]:first[i + 1]`` are the words of text i; a text of fewer words than
    a span has none.
    """
    k = gram_size(span)
    w = span - k + 1
    end = np.repeat(first[1:], np.diff(first))
    n = len(words) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        gram = np.zeros(n, np.uint64)
        for j in range(k):
            gram = gram * np.uint64(0x9E3779B97F4A7C15) + words[j:j + n]
    gram = mix(gram)
    begin = np.flatnonzero(np.arange(n) + span <= end[:n])       # whole span in one text
    best, at = gram[begin], begin.copy()
    for j in range(1, w):
        other = gram[begin + j]
        better = other <= best
        best[better] = other[better]
        at[better] = begin[better] + j
    at = np.unique(at)
    return at, gram[at]


def _around(words: np.ndarray, first: np.ndarray, text: np.ndarray, at: np.ndarray, span: int,
            outside: int) -> np.ndarray:
    """The words a span that holds the k-gram at ``at`` can reach; ``outside``
    marks places beyond the text, differently for either side of the join."""
    k = gram_size(span)
    place = at[:, None] + np.arange(k - span, span)
    inside = (place >= first[text][:, None]) & (place < first[text + 1][:, None])
    return np.where(inside, words[np.clip(place, 0, max(len(words) - 1, 0))], np.uint64(outside))


def _hits(words, first, spans, keep, outside):
    """Per text the kept fingerprints of every class: (text, span, gram, at, words)."""
    found = []
    for span in spans:
        at, gram = fingerprints(words, first, span)
        text = np.searchsorted(first, at, "right") - 1
        good = keep(span, gram, np.diff(first)[text])
        at, gram, text = at[good], gram[good], text[good]
        context = _around(words, first, text, at, span, outside)
        found += [(int(t), span, int(g), int(p - first[t]), c) for t, g, p, c in zip(
            text, gram.view(np.int64), at, context.view(np.int64).tolist())]
    return sorted(found, key=lambda x: (x[0], x[1], x[3]))


def _fingerprint_rows(spans: list[int], keep, outside: int):
    """mapInArrow function: (id, text) -> (id, n_words, hits)."""
    kind = pa.struct([("span", pa.int32()), ("gram", pa.int64()), ("at", pa.int64()),
                      ("words", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.zeros(batch.num_rows, np.int64)
            rows: list[list] = [[] for _ in range(batch.num_rows)]
            for chunk in text_chunks(batch.column(1)):
                words, first = chunk_words(chunk)
                counts[chunk.first:chunk.first + chunk.n] = np.diff(first)
                for text, span, gram, at, around in _hits(words, first, spans, keep, outside):
                    rows[chunk.first + text].append(
                        {"span": span, "gram": gram, "at": at, "words": around})
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), pa.array(rows, pa.list_(kind))],
                ["doc_id", "n_words", "hits"])
    return run


def _bit(gram: np.ndarray, span: int) -> np.ndarray:
    return mix(gram ^ np.uint64(span)) >> np.uint64(64 - FILTER_BITS)


def benchmark_fingerprints(benchmark: DataFrame, item_col: str = "item_id",
                           text_col: str = "text") -> DataFrame:
    """``(item, span, gram, at, words)``: an item's class is its length, at most SPAN."""
    rows = id_and_text(benchmark, item_col, text_col).select(
        F.col("doc_id").cast("string").alias("doc_id"), "text")
    own = lambda span, gram, n_words: np.minimum(n_words, SPAN) == span
    found = rows.mapInArrow(_fingerprint_rows(list(range(1, SPAN + 1)), own, 1),
                            f"doc_id string, n_words long, hits array<{_HIT}>")
    return found.select(F.col("doc_id").alias("item"), F.inline("hits")).distinct()


def _filter(prints: DataFrame) -> tuple[list[int], np.ndarray]:
    """Classes in use and the bit set over (class, hash)."""
    def run(batches):
        for batch in batches:
            span = batch.column(0).to_numpy().astype(np.uint64)
            gram = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            bit = mix(gram ^ span) >> np.uint64(64 - FILTER_BITS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array((bit >> np.uint64(6)).astype(np.int64)),
                 pa.array((np.uint64(1) << (bit & np.uint64(63))).view(np.int64))],
                ["span", "word", "bits"])

    marked = prints.select("span", "gram").mapInArrow(run, "span int, word long, bits long")
    parts = marked.groupBy("span", "word").agg(F.bit_or("bits").alias("bits")).toPandas()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    np.bitwise_or.at(bits, parts["word"].to_numpy(np.int64),
                     parts["bits"].to_numpy(np.int64).view(np.uint64))
    return sorted({int(s) for s in parts["span"]}), bits


def _windows(hits: DataFrame, outside: int) -> DataFrame:
    """Every window of ``span`` words that holds a kept k-gram, inside one text:
    ``window`` (its words) and ``lo`` (its first place) instead of ``at`` and ``words``."""
    reach = F.col("span") - F.least(F.col("span"), F.lit(GRAM))
    each = hits.withColumn("o", F.explode(F.sequence(F.lit(0), reach)))
    lo = F.col("at") - reach + F.col("o")
    keep = [c for c in hits.columns if c not in ("at", "words")]
    return (each.select(*keep, lo.alias("lo"), F.slice("words", F.col("o") + 1, F.col("span")).alias("window"))
            .where(~F.array_contains("window", F.lit(outside).cast("long"))))


def _owners(tests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(span, gram, window, class)``: distinct windows of the items, each with the class
    of the items that hold it, and ``(class, items)``."""
    held = stored(_windows(tests, 1).groupBy("span", "window").agg(
        F.collect_set("gram").alias("grams"), F.sort_array(F.collect_set("item")).alias("items")), "winnow-held")
    classes = stored(held.select("items").distinct().withColumn("class", F.monotonically_increasing_id()),
                     "winnow-classes")
    windows = held.join(classes, "items").select("span", F.explode("grams").alias("gram"), "window", "class")
    return stored(windows, "winnow-windows"), classes


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str,
           item_text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(row, doc_id, digest, n_words)``, its hits ``(row, lo, hi, class)`` and the classes.

    Windows that several items share are one row on the test side, so documents and
    items with a common passage meet in that row and not in pairs."""
    tests = stored(benchmark_fingerprints(benchmark, item_col, item_text_col), "winnow-tests")
    spans, bits = _filter(tests)
    windows, classes = _owners(tests)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def known(span, gram, n_words):
        bit = _bit(gram, span)
        return (shared.value[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) != 0

    source = id_and_text(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    found = source.withColumn("doc_id", F.struct("doc_id", F.xxhash64("doc_id", "text").alias("digest")))
    found = found.mapInArrow(_fingerprint_rows(spans, known, 0),
                             f"doc_id struct<doc_id:{kind},digest:long>, n_words long, hits array<{_HIT}>")
    rows = stored(found.withColumn("row", F.monotonically_increasing_id()), "winnow-docs")
    near = _windows(rows.select("row", F.inline("hits")), 0)
    hits = near.join(windows, ["span", "gram", "window"]).select(
        "row", "lo", (F.col("lo") + F.col("span")).alias("hi"), "class")
    return (rows.select("row", "doc_id.doc_id", "doc_id.digest", "n_words"),
            stored(hits, "winnow-hits"), classes)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text") -> DataFrame:
    """``(doc_id, digest, n_words, n_hit, items array<string>)``, one row per input row.

    A document word is hit when it lies in an occurrence of ten consecutive words
    of an item, or of a whole shorter item.  ``items`` are the ids of the items
    with such occurrences, as sorted distinct strings; an item without an id hits
    words but is not listed.  ``digest`` is a hash of id and text by which rows of
    one id can be told apart.  Null and blank texts and items have no words;
    repeated rows and items change nothing; empty tables give no hits or no rows.
    """
    rows, hits, classes = _found(docs, benchmark, id_col, text_col, item_col, item_text_col)
    # Rows that hit the same classes share one list of items.
    per_row = stored(_hit_words(hits).join(
        hits.groupBy("row").agg(F.sort_array(F.collect_set("class")).alias("met")), "row"), "winnow-rows")
    sets = per_row.select("met").distinct()
    listed = sets.select("met", F.explode("met").alias("class")).join(classes, "class").groupBy("met").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    per_row = per_row.join(listed, "met").select("row", "n_hit", "items")
    return rows.join(per_row, "row", "left").select(
        "doc_id", "digest", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                   text_col: str = "text", item_col: str = "item_id",
                   item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a hit word, all columns in place.

    The hit rows are written out first, so Spark knows their size and only
    shuffles the documents when they are too many to broadcast.
    """
    rows, hits, _ = _found(docs, benchmark, id_col, text_col, item_col, item_text_col)
    hit = stored(rows.join(hits.select("row").distinct(), "row").select(
        F.col("doc_id").alias("__hit_id"), F.col("digest").alias("__hit_digest")).distinct(), "winnow-hit")
    here = (F.col(id_col).eqNullSafe(F.col("__hit_id"))
            & (F.xxhash64(F.col(id_col), F.col(text_col)) == F.col("__hit_digest")))
    return docs.join(hit, here, "left_anti")


def _hit_words(runs_: DataFrame) -> DataFrame:
    """``(row, n_hit)``: words covered by the union of a row's runs."""
    before = Window.partitionBy("row").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.greatest(F.col("lo"), F.coalesce(F.max("hi").over(before), F.lit(0)))
    return (runs_.select("row", "lo", "hi").distinct()
            .withColumn("new", F.greatest(F.col("hi") - reach, F.lit(0)))
            .groupBy("row").agg(F.sum("new").alias("n_hit")))
