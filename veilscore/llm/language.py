"""Language identification by prediction by partial matching (PPM).

One variable-order byte context tree per language is counted on a bounded sample
of labelled rows and then frozen.  A text's code length under a tree is the exact
sum of the code lengths of its bytes: the longest kept context codes the byte
(escape method C, symbols of longer contexts excluded), else an escape is coded
and the next shorter context is tried, down to a uniform code.  The language with
the shortest code wins.

Because statistics are frozen, the code length of a byte depends on its last
``ORDER`` bytes only.  It is tabulated once for every kept context, language and
byte in units of 2^-16 bit; whole texts are then scored with table look-ups and
integer sums, so results do not depend on batch or partition borders.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textbytes import LOWER, id_and_text, text_chunks

ORDER = 3
UNDETERMINED = "und"
#: Expected bytes of sampled text per language (whole documents, chosen by a hash
#: of their id); the bound of the training sample.
TRAIN_BYTES = 4 << 20
#: Most contexts of an order that a language keeps: the commonest in its own texts.
MAX_CONTEXTS = 1 << 14
#: Bytes of the code lengths (contexts x symbols x languages x 4).  Many languages
#: keep fewer contexts each, so that the model stays within it.
MODEL_BYTES = 96 << 20
MIN_COUNT = 3
#: Most languages that can be learned.
MAX_LANGUAGES = 1000
_UNIT = 1 << 16

# ASCII letters in lower case, every other ASCII byte is a gap, the rest stays.
_GAP = 0x20
_FOLD = LOWER.copy()
_FOLD[:0x80] = np.where((LOWER[:0x80] >= 0x61) & (LOWER[:0x80] <= 0x7A), LOWER[:0x80], _GAP)


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters and non-ASCII bytes with single gaps between; new offsets."""
    out = _FOLD[data]
    gap = out == _GAP
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    keep[offsets[:-1][offsets[:-1] < len(data)]] = True
    place = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    return out[keep], place[offsets]


def _previous(values: np.ndarray, offsets: np.ndarray, back: int) -> np.ndarray:
    """The value ``back`` places before, 0 beyond the start of the document."""
    out = np.zeros_like(values)
    out[back:] = values[:-back] if back < len(values) else values[:0]
    heads = offsets[:-1]
    for k in range(back):
        at = heads + k
        out[at[at < offsets[1:]]] = 0
    return out


# ----------------------------------------------------------------- training
def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (language, last ORDER bytes + byte) per batch chunk."""
    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), object)
        for lang in sorted(set(langs)):
            column = batch.column(0).filter(pa.array(langs == lang))
            for chunk in text_chunks(column, 8 << 20):
                data, offsets = folded(chunk.data, chunk.offsets)
                code = data.astype(np.uint32)
                for k in range(1, ORDER + 1):
                    code |= _previous(data, offsets, k).astype(np.uint32) << np.uint32(8 * k)
                code, n = np.unique(code, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(code), pa.string()),
                     pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))],
                    ["lang", "code", "n"])


def training_sample(docs: DataFrame, lang_col: str, id_col: str, text_col: str,
                    allowed: Column | None, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """Labelled rows ``(text, lang)``, thinned per language to about ``train_bytes``."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    if allowed is not None:
        rows = rows.filter(allowed)
    rows = rows.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       F.col(lang_col).cast("string").alias("lang"))
    sizes = (rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("size"))
             .limit(MAX_LANGUAGES + 1).collect())
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    share = {r["lang"]: train_bytes / max(r["size"], 1) for r in sizes}
    if not share:
        return rows.select("text", "lang").filter(F.lit(False))
    draw = F.abs(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")) % (1 << 40)) / float(1 << 40)
    wanted = F.create_map(*[F.lit(x) for pair in sorted(share.items()) for x in pair])
    return rows.filter(draw < wanted[F.col("lang")]).select("text", "lang")


@dataclass
class LanguageModel:
    """Frozen code lengths: ``lengths[state * symbols + byte symbol, language]``."""
    languages: list[str]
    symbol: np.ndarray            # byte -> symbol, 0 for bytes never learned
    symbols: int
    state: np.ndarray             # the last ORDER symbols -> state
    lengths: np.ndarray

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of every document under every language, in 2^-16 bit."""
        out = np.zeros((len(offsets) - 1, len(self.languages)), np.int64)
        data, offsets = folded(data, offsets)
        full = np.flatnonzero(offsets[1:] > offsets[:-1])
        if len(full):
            s = self.symbol[data]
            context = np.zeros(len(s), np.int32)
            for k in range(ORDER, 0, -1):
                context = context * self.symbols + _previous(s, offsets, k)
            at = self.state[context] * self.symbols + s
            out[full] = np.add.reduceat(self.lengths.take(at, axis=0), offsets[full], axis=0,
                                        dtype=np.int64)
        return out


def build_model(counts: pd.DataFrame, max_contexts: int = MAX_CONTEXTS, min_count: int = MIN_COUNT,
                model_bytes: int = MODEL_BYTES) -> LanguageModel | None:
    """Model from ``(lang, code, n)``; None without any counted byte.  An order without
    a context that is common enough is left out: shorter ones code its bytes."""
    if not len(counts):
        return None
    languages = sorted(counts["lang"].unique())
    lang = np.searchsorted(languages, counts["lang"].to_numpy(object).astype(str))
    code, n = counts["code"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)
    symbol = np.zeros(256, np.int32)
    seen = np.unique(code & 0xFF)
    symbol[seen] = np.arange(1, len(seen) + 1)
    size = len(seen) + 1
    last = symbol[code & 0xFF]
    back = [symbol[(code >> (8 * k)) & 0xFF].astype(np.int64) for k in range(1, ORDER + 1)]

    # Contexts of each order as numbers in base ``size``, oldest symbol first.
    number = [np.zeros(len(code), np.int64)]
    for k in range(ORDER):
        number.append(back[k] * size ** k + number[-1])
    quota = (model_bytes // (4 * size * len(languages)) - size - 1) // (2 * len(languages))
    if quota < 1:
        raise ValueError(f"{len(languages)} languages of {size} symbols do not fit in {model_bytes} bytes")
    quota = min(quota, max_contexts)
    kept = [np.zeros(1, np.int64)]
    for k in range(1, ORDER + 1):
        values, where = np.unique(number[k], return_inverse=True)
        known = np.isin(values % size ** (k - 1), kept[-1])
        mine: list[np.ndarray] = []
        for which in range(len(languages)):                 # every language chooses its own
            total = np.bincount(where, weights=np.where(lang == which, n, 0)).astype(np.int64)
            fit = np.flatnonzero(known & (total >= (min_count if k > 1 else 1)))
            if k > 1 and len(fit) > quota:                  # commonest, ties by number
                fit = fit[np.lexsort((values[fit], -total[fit]))[:quota]]
            mine.append(values[fit])
        kept.append(np.unique(np.concatenate(mine)))

    first = np.cumsum([0] + [len(v) for v in kept])
    lengths = np.zeros((int(first[-1]), size, len(languages)), np.int32)
    for which in range(len(languages)):
        mine = lang == which
        tables = []
        for k in range(ORDER + 1):
            table = np.zeros((len(kept[k]), size), np.int64)
            ok = np.isin(number[k][mine], kept[k])           # an order may have no context
            row = np.searchsorted(kept[k], number[k][mine][ok])
            np.add.at(table, (row, last[mine][ok]), n[mine][ok])
            tables.append(table)
        for k in range(ORDER + 1):
            lengths[first[k]:first[k + 1], :, which] = _code_lengths(kept, tables, k, size)

    state = np.zeros((size,) * ORDER, np.int32)
    for k in range(1, ORDER + 1):
        digits = [(kept[k] // size ** i) % size for i in range(k - 1, -1, -1)]
        state[(..., *digits)] = np.arange(first[k], first[k + 1], dtype=np.int32)
    return LanguageModel(languages, symbol, size, state.reshape(-1),
                         lengths.reshape(-1, len(languages)))


def _code_lengths(kept: list[np.ndarray], tables: list[np.ndarray], order: int,
                  size: int) -> np.ndarray:
    """PPM code lengths of every symbol after every kept context of an order."""
    contexts = kept[order]
    out = np.zeros((len(contexts), size))
    open_ = np.ones((len(contexts), size), bool)
    spent = np.zeros(len(contexts))
    for k in range(order, -1, -1):
        rows = np.searchsorted(kept[k], contexts % size ** k)
        count = np.where(open_, tables[k][rows], 0)
        total, distinct = count.sum(axis=1), (count > 0).sum(axis=1)
        whole = np.maximum(total + distinct, 1)
        hit = count > 0
        out[hit] = (spent[:, None] + np.log2(whole)[:, None] - np.log2(np.maximum(count, 1)))[hit]
        spent += np.where(distinct > 0, np.log2(whole) - np.log2(np.maximum(distinct, 1)), 0.0)
        open_ &= ~hit
    rest = spent + np.log2(np.maximum(open_.sum(axis=1), 1))
    out = np.where(open_, rest[:, None], out)
    return np.rint(out * _UNIT).astype(np.int64)


def train(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
          allowed: Column | None = None, train_bytes: int = TRAIN_BYTES) -> LanguageModel | None:
    """Count the sample in Spark, freeze the trees on the driver (their size is
    bounded by ``train_bytes`` per language and ``MODEL_BYTES``)."""
    sample = training_sample(docs, lang_col, id_col, text_col, allowed, train_bytes)
    counts = (sample.mapInArrow(_grams, "lang string, code long, n long")
              .groupBy("lang", "code").agg(F.sum("n").alias("n")))
    return build_model(counts.toPandas())


# --------------------------------------------------------------- prediction
def has_letter(raw: bytes) -> bool:
    return any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def scored(model: LanguageModel | None, texts: pa.Array) -> tuple[list[str], list[float]]:
    """Language and score of every text of a column."""
    names: list[str] = []
    scores: list[float] = []
    for chunk in text_chunks(texts):
        if model is None:
            names += [UNDETERMINED] * chunk.n
            scores += [0.0] * chunk.n
            continue
        plain = _FOLD[chunk.data]
        found = np.zeros(len(plain) + 1, np.int64)
        np.cumsum((plain != _GAP) & (plain < 0x80), out=found[1:])
        letters = found[chunk.offsets[1:]] > found[chunk.offsets[:-1]]
        for i in np.flatnonzero(~letters):           # no ASCII letter: look at the others
            letters[i] = has_letter(chunk.data[chunk.offsets[i]:chunk.offsets[i + 1]].tobytes())
        bits = model.bits(chunk.data, chunk.offsets)
        best = bits.argmin(axis=1)
        gap = (bits - bits.min(axis=1, keepdims=True)) / _UNIT
        share = 1.0 / np.exp2(-np.minimum(gap, 1000.0)).sum(axis=1)
        names += [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best, letters)]
        scores += np.where(letters, share, 0.0).tolist()
    return names, scores


def predict(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)``, one row per input row, whole texts.

    ``score`` is the winner's share of the posterior under equal priors (1 over
    the sum of 2^-(bits - fewest bits)); ties go to the first language by name.
    Null texts, texts without a letter and all texts of an empty model are
    ``und`` with score 0.  Repeated rows and null ids are kept; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = scored(shared.value, batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "lang_pred", "score"])

    source = id_and_text(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def identified(docs: DataFrame, model: LanguageModel | None, min_score: float = 0.5,
               lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a language, all columns in place.

    Rejected are null texts, texts without a letter and texts whose best language
    has a score below ``min_score``.  A null ``lang_col`` gets the language found.
    An empty model (no labelled text) rejects nothing.
    """
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text_at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = scored(shared.value, batch.column(text_at))
            keep = pa.array([n != UNDETERMINED and s >= min_score for n, s in zip(names, scores)],
                            pa.bool_())
            columns = batch.columns
            columns[lang_at] = pc.coalesce(columns[lang_at], pa.array(names, columns[lang_at].type))
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(keep)

    # By position: names with dots or repeated names are no column references.
    plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)])
    return docs.toDF(*plain.names).mapInArrow(run, plain).toDF(*docs.columns)
