"""Spelling variants by a trie-node pair dictionary.

Distinct words are sorted forwards and, reversed, backwards; in sorted order a word's
new trie nodes are those behind the beginning it shares with the word before, so
both tries are numbered by running counts.  Every word then writes integer pairs
(prefix node, suffix node): one per code point it may skip and one per place where a
code point may be inserted.

* Two words that skip a code point at the same pair differ by one replacement.
* A word that skips a code point at a pair where another word is split differs from
  it by one deletion.  Skipping any code point of a run of equal ones gives the same
  word, so only the first of a run counts.

Both ways every pair of neighbours meets exactly once, and exactly.  A pair is
written only if both of its nodes are shared with another word.  Words that meet at
one pair differ in one code point, so they are at most as many as the alphabet; the
pairs are shuffled, sorted and summed up per word, word pairs are never written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import released, stored
from .textbytes import common_beginnings

#: Rows of pairs that are written at a time.
_ROWS = 1 << 18


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, and where each word begins."""
    first = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(w) for w in words], dtype=np.int64)])
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32), first


# ------------------------------------------------------------------- numbering
def _local_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trie nodes of the words of a sorted partition, numbered from 1.

    Adds ``place`` (from 1), ``made`` (nodes made so far) and ``nodes``, the numbers
    of the word's beginnings as far as a word beside it shares them; all of them for
    the first and last word of a batch, whose neighbours are not at hand."""
    before, its_nodes, made, place = None, np.zeros(0, np.int64), 0, 0
    for batch in batches:
        words = batch.column(batch.schema.get_field_index("key")).to_pylist()
        if not words:
            continue
        letters, first = _letters(words)
        size = np.diff(first)
        shared = np.zeros(len(words) + 1, np.int64)
        shared[1:-1] = common_beginnings(letters, first)
        if before is not None:
            shared[0] = common_beginnings(*_letters([before, words[0]]))[0]
        own = size - shared[:-1]
        upto = made + np.cumsum(own)
        start = upto - own - shared[:-1]             # a new node of depth d has number start + d
        reach = np.maximum(shared[:-1], shared[1:])
        reach[-1] = size[-1]
        if before is None:
            reach[0] = size[0]
        at = np.concatenate([np.zeros(1, np.int64), np.cumsum(reach)])
        nodes = np.repeat(start - at[:-1], reach) + np.arange(at[-1]) + 1
        live, depth = np.flatnonzero(shared[:-1] > 0), 1
        while len(live):                             # beginnings shared with the word before
            lead = np.concatenate([[True], np.diff(live) > 1])
            leader = live[np.maximum.accumulate(np.where(lead, np.arange(len(live)), 0))] - 1
            nodes[at[live] + depth - 1] = np.where(
                leader >= 0, start[leader] + depth, its_nodes[depth - 1] if depth <= len(its_nodes) else 0)
            depth += 1
            live = live[shared[live] >= depth]
        count = np.arange(place + 1, place + len(words) + 1)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(count), pa.array(upto),
             pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(nodes))],
            [*batch.schema.names, "place", "made", "nodes"])
        before, its_nodes, made, place = words[-1], nodes[at[-2]:], int(upto[-1]), place + len(words)


def _borders(spark: SparkSession, local: DataFrame) -> DataFrame:
    """Per partition: words and nodes before it, and the numbers of its first word's
    beginnings that the partition before already has (a row per partition)."""
    rows = local.groupBy("part").agg(
        F.max("place").alias("words"), F.max("made").alias("made"), F.min_by("key", "place").alias("first"),
        F.max_by("key", "place").alias("last"), F.max_by("nodes", "place").alias("nodes")).orderBy("part").collect()
    out, words, made, last, known = [], 0, 0, None, []
    for r in rows:
        shared = int(common_beginnings(*_letters([last, r["first"]]))[0]) if last is not None else 0
        heads = known[:shared]
        out.append((r["part"], words, made, heads))
        known = [heads[x - 1] if x <= len(heads) else made + x for x in r["nodes"]]
        words, made, last = words + r["words"], made + r["made"], r["last"]
    return spark.createDataFrame(out, "part int, words_before long, nodes_before long, heads array<long>")


def _with_nodes(words: DataFrame, key: Column, name: str) -> DataFrame:
    """``words`` with ``name``, the trie nodes of the beginnings of ``key`` that other
    rows share, and ``place``, the row's rank by ``key`` from 1."""
    ranged = (words.withColumn("key", key).repartitionByRange("key").sortWithinPartitions("key")
              .withColumn("part", F.spark_partition_id()))
    schema = T.StructType([*ranged.schema.fields, T.StructField("place", T.LongType()), T.StructField("made", T.LongType()),
                           T.StructField("nodes", T.ArrayType(T.LongType()))])
    local = stored(ranged.mapInArrow(_local_nodes, schema), f"variant-{name}")
    known = lambda x: F.when(x <= F.size("heads"), F.get("heads", (x - 1).cast("int"))).otherwise(
        F.col("nodes_before") + x)
    return local.join(_borders(words.sparkSession, local), "part").select(
        *words.columns, (F.col("words_before") + F.col("place")).alias("place"),
        F.transform("nodes", known).alias(name))


# ----------------------------------------------------------------------- pairs
def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every number of every range low..high (inclusive) and its range's index."""
    size = np.maximum(high - low + 1, 0)
    owner = np.repeat(np.arange(len(size)), size)
    return owner, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - low, size)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(prefix node, suffix node, id, n, kind): kind 0 splits the word at the pair, 1
    skips a code point, 2 skips the first of a run of equal ones."""
    for batch in batches:
        words = batch.column(1).to_pylist()
        letters, first = _letters(words)
        size = np.diff(first)
        lists = []
        for column in (batch.column(3), batch.column(4)):
            cut = column.offsets.to_numpy().astype(np.int64)
            values = np.append(column.values.to_numpy(zero_copy_only=False), 0)
            lists.append((values, cut, np.diff(cut)))
        (prefix, p_at, p_n), (suffix, s_at, s_n) = lists
        ids, n = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        for lo, hi in _chunks(2 * size):
            part = slice(lo, hi)
            for skip in (1, 0):
                rest = size[part] - skip
                word, i = _ranges(np.maximum(rest - s_n[part], 0), np.minimum(rest, p_n[part]))
                word = word + lo
                behind = size[word] - skip - i
                p = np.where(i > 0, prefix[np.where(i > 0, p_at[word] + i - 1, 0)], 0)
                s = np.where(behind > 0, suffix[np.where(behind > 0, s_at[word] + behind - 1, 0)], 0)
                kind = np.zeros(len(i), np.int8)
                if skip:
                    here = first[word] + i
                    kind[:] = 1 + ((i == 0) | (letters[here] != letters[np.maximum(here - 1, 0)]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p), pa.array(s), pa.array(ids[word]), pa.array(n[word]), pa.array(kind)],
                    ["prefix", "suffix", "id", "n", "kind"])


def _chunks(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows with about _ROWS in all."""
    upto, lo = np.cumsum(size), 0
    while lo < len(size):
        hi = int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + _ROWS, "right"))
        hi = max(hi, lo + 1)
        yield lo, hi
        lo = hi


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each word meets at each pair: rows sorted by pair, then by falling n and
    rising id, so that of two words the one further up is the better form."""
    rest: pa.RecordBatch | None = None

    def met(rows: pa.Table) -> pa.RecordBatch:
        p, s, ids, n, kind = (rows.column(c).to_numpy() for c in ("prefix", "suffix", "id", "n", "kind"))
        row = np.arange(len(p))
        opens = np.append(True, (p[1:] != p[:-1]) | (s[1:] != s[:-1]))
        head = np.flatnonzero(opens)
        own = np.cumsum(opens) - 1
        none = len(p)
        upmost = lambda mask: np.minimum.reduceat(np.where(mask, row, none), head)[own]
        count = lambda mask: np.add.reduceat(mask.astype(np.int64), head)[own]           # noqa: E731
        skips, firsts = kind > 0, kind == 2
        one = upmost(skips)
        two = upmost(skips & (row != one))
        first, split = upmost(firsts), upmost(kind == 0)
        deletes = firsts & (split < none)
        near = np.where(skips, count(skips) - 1 + deletes, count(firsts))
        best = np.where(skips, np.minimum(np.where(row == one, two, one), np.where(deletes, split, none)), first)
        hit = near > 0
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[hit]), pa.array(near[hit]), pa.array(n[best[hit]]), pa.array(ids[best[hit]])],
            ["id", "near", "form_n", "form"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch] if rest is None else [rest, batch])
        p, s = rows.column("prefix").to_numpy(), rows.column("suffix").to_numpy()
        open_ = np.flatnonzero((p != p[-1]) | (s != s[-1]))
        done = int(open_[-1]) + 1 if len(open_) else 0          # the last pair may go on
        rest = rows.slice(done).combine_chunks().to_batches()[0]
        if done:
            yield met(rows.slice(0, done))
    if rest is not None:
        yield met(pa.Table.from_batches([rest]))


# -------------------------------------------------------------------- operator
def word_counts(runs: DataFrame, word: Column, min_length: int = 7, min_count: int = 2) -> DataFrame:
    """``(word, n)``: distinct values of ``word`` with ``min_length`` code points and
    ``min_count`` rows at least."""
    return (runs.select(word.alias("word")).where(F.length("word") >= min_length)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count))


def letter_runs(docs: DataFrame, min_length: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, run)``: maximal runs of Latin letters of whole texts with
    ``min_length`` letters at least, A-Z lower-cased; null and empty texts have none."""
    text = F.col(text_col).cast("string")
    runs = F.regexp_extract_all(text, F.lit(f"[A-Za-zÀ-ÿ]{{{min_length},}}"), F.lit(0))
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(runs).alias("run")).select(
        "doc_id", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for distinct words ``(word, n)``.

    ``n_near`` counts the words that differ by exactly one inserted, deleted or
    replaced code point.  ``form`` is the near word of largest n (ties: smallest in
    code-point order) if that is at least ``ratio`` times the word's own, else null;
    ``root`` follows forms to the last one (the word itself without a form).  ``ratio``
    must be above 1, so that forms lead upwards.

    Words of any length are taken; null words and words of no code points are left
    out; no rows give no rows; further columns are not read.
    """
    if ratio <= 1:
        raise ValueError("a form must be more frequent than its variants")
    base = stored(words.select(F.col("word").cast("string").alias("word"), F.col("n").cast("long").alias("n"))
                  .where(F.length("word") > 0), "variant-words")
    ranked = stored(_with_nodes(base, F.col("word"), "prefixes").withColumnRenamed("place", "id"), "variant-forward")
    both = _with_nodes(ranked, F.reverse("word"), "suffixes")
    pairs = both.select("id", "word", "n", "prefixes", "suffixes").mapInArrow(
        _pairs, "prefix long, suffix long, id long, n long, kind byte")
    met = (pairs.repartition("prefix", "suffix")
           .sortWithinPartitions("prefix", "suffix", F.col("n").desc(), "id")
           .mapInArrow(_meet, "id long, near long, form_n long, form long"))
    near = met.groupBy("id").agg(F.sum("near").alias("n_near"),
                                 F.max(F.struct("form_n", (-F.col("form")).alias("form"))).alias("best"))
    names = ranked.select("id", "word", "n")
    found = stored(names.join(near, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(F.col("best.form_n") >= ratio * F.col("n"), F.struct(
            (-F.col("best.form")).alias("id"), F.col("best.form_n").alias("n"))).alias("form")), "variant-found")
    roots = _roots(found.where(F.col("form").isNotNull()).select("id", F.col("form.id").alias("root")))
    linked = roots.join(names.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").join(
        found.select("id", F.col("form.id").alias("form")).join(
            names.select(F.col("id").alias("form"), F.col("word").alias("form_word")), "form"), "id").select(
        F.col("id").alias("of"), "form_word", "root_word")
    return found.join(linked, F.col("id") == F.col("of"), "left").select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"),
        "n", "n_near", F.col("form.n").alias("form_n"))


def _roots(links: DataFrame) -> DataFrame:
    """``(id, root)`` with every link followed to its end, doubling the step per round.
    Links lead to words that are ``ratio`` times as frequent, so chains are short."""
    now = stored(links, "variant-roots")
    while True:
        ahead = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        after = stored(now.join(ahead, "root", "left").select(
            "id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variant-roots")
        released(now)
        if not after.where("moved").limit(1).count():
            return after.select("id", "root")
        now = after
