"""Ranked lexical search over a document FP-tree.

Documents are reduced to the terms that some query item has, as vectors of (term,
tf) with terms in falling document frequency.  Sorted by that term sequence,
documents that share its beginning lie together: every run of documents with a
common beginning is a node of a prefix tree.  A node keeps, for each term, the
largest tf below it and the smallest length norm m; since a term's part of the
score grows with tf and falls with m, these bound the score of every document
below.  Per item the tree is searched depth first, the child with the highest bound
first; a subtree whose bound cannot reach the item's current last place is left out.

Spark sorts the vectors by range exchange on the first terms, the hash of the whole
sequence and the id (so no sequence is too hot for a range), and by sequence within a
range: a task cuts its sorted rows into trees of bounded size and keeps the best documents of every item from tree to tree.  The
best of all tasks are merged by a ranked window with a limit before the exchange.
All weights and scores are integers, so bounds and results are exact.

Score of a document for an item: the sum over the item's terms, repeats included,
of ``w * ((1000000000 * tf) div (1000 * tf + 12 * m))`` with
``w = floor(1000 * ln((2N + 2) / (2 df + 1)))`` and
``m = 75 + (25 * n * N) div L``; N documents have terms, L terms in all, n in this
one, df documents hold the term.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import running_totals
from .scratch import released, stored
from .textbytes import LOWER, common_beginnings, id_and_text, runs, text_chunks, word_hashes

#: Results per item.
TOP = 20
#: Text bytes of items that are searched for together; their terms are broadcast,
#: so this (and one item more) is the bound of the broadcast.
BLOCK_BYTES = 4 << 20
#: Documents below a leaf, and cells (leaves x terms, or vector entries) of a tree.
LEAF = 64
TREE_CELLS = 1 << 21
TREE_DOCS = 1 << 15
#: Leading terms that decide a document's range.
RANGE_TERMS = 8

_IS_TERM = np.zeros(256, bool)
_IS_TERM[0x30:0x3A] = _IS_TERM[0x41:0x5B] = _IS_TERM[0x61:0x7B] = True
_IS_TERM[0x80:] = True


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, start and end of every term."""
    starts, ends = runs(_IS_TERM[data], offsets)
    return LOWER[data], starts, ends


# ------------------------------------------------------------------ vocabulary
@dataclass
class Vocabulary:
    """The distinct terms of some items, found by hash and compared byte by byte."""
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray              # sorted
    seed: int

    @property
    def n(self) -> int:
        return len(self.starts)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of every term, -1 for others."""
        if not len(starts) or not self.n:
            return np.full(len(starts), -1, np.int64)
        hashes = word_hashes(data, starts, ends, self.seed)
        at = np.minimum(np.searchsorted(self.hashes, hashes), self.n - 1)
        hit = np.flatnonzero((self.hashes[at] == hashes) & (self.ends[at] - self.starts[at] == ends - starts))
        live, k = hit, 0
        wrong = []
        while len(live):                            # one step per byte position
            same = data[starts[live] + k] == self.data[self.starts[at[live]] + k]
            wrong.append(live[~same])
            k += 1
            live = live[same]
            live = live[ends[live] - starts[live] > k]
        out = np.full(len(starts), -1, np.int64)
        out[hit] = at[hit]
        for w in wrong:
            out[w] = -1
        return out


def vocabulary(words: list[bytes]) -> Vocabulary:
    """Vocabulary of distinct words; hashes are made distinct by choice of the seed."""
    for seed in range(1, 100):
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]]) if len(words) else ends
        data = np.frombuffer(b"".join(words), np.uint8)
        hashes = word_hashes(data, starts, ends, seed)
        order = np.argsort(hashes, kind="stable")
        if len(np.unique(hashes)) == len(words):
            return Vocabulary(data, starts[order], ends[order], hashes[order], seed)
    raise RuntimeError("no seed gives the terms distinct hashes")


def _item_terms(texts: list[str | None]) -> list[list[bytes]]:
    out = []
    for text in texts:
        data = np.frombuffer((text or "").encode(), np.uint8)
        lower, starts, ends = _terms(data, np.array([0, len(data)], np.int64))
        raw = lower.tobytes()
        out.append([raw[s:e] for s, e in zip(starts, ends)])
    return out


# --------------------------------------------------------------------- vectors
def _vectors(shared):
    """(doc_id, n, terms, tfs): restricted vectors as packed 32-bit numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        for batch in batches:
            for chunk in text_chunks(batch.column(1)):
                data, starts, ends = _terms(chunk.data, chunk.offsets)
                first = np.searchsorted(starts, chunk.offsets, "left")
                found = vocab.find(data, starts, ends)
                doc = np.repeat(np.arange(chunk.n), np.diff(first))
                hit = found >= 0
                cell, tf = np.unique(doc[hit] * max(vocab.n, 1) + found[hit], return_counts=True)
                owner = cell // max(vocab.n, 1)
                cut = np.searchsorted(owner, np.arange(chunk.n + 1)) * 4
                terms = (cell % max(vocab.n, 1)).astype(np.uint32).tobytes()
                tfs = tf.astype(np.uint32).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(chunk.first, chunk.n), pa.array(np.diff(first)),
                     pa.array([terms[a:b] for a, b in zip(cut, cut[1:])], pa.binary()),
                     pa.array([tfs[a:b] for a, b in zip(cut, cut[1:])], pa.binary())],
                    ["doc_id", "n", "terms", "tfs"])
    return run


def _numbers(column: pa.Array, kind=np.uint32) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a packed column and where each row's begin."""
    raw = column.to_pylist()
    size = np.array([len(r) for r in raw], np.int64) // np.dtype(kind).itemsize
    return (np.frombuffer(b"".join(raw), kind).astype(np.int64),
            np.concatenate([np.zeros(1, np.int64), np.cumsum(size)]))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        term, df = np.unique(_numbers(batch.column(0))[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(df)], ["term", "df"])


def _paths(rank: np.ndarray, total: int, length: int):
    """(doc_id, path, tfs, m): terms as ranks of falling document frequency, packed
    with the high byte first so that bytes sort like ranks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, first = _numbers(batch.column(2))
            tf, _ = _numbers(batch.column(3))
            doc = np.repeat(np.arange(batch.num_rows), np.diff(first))
            order = np.lexsort((rank[term], doc))
            path, tfs = rank[term[order]].astype(">u4").tobytes(), tf[order].astype(np.uint32).tobytes()
            n = batch.column(1).to_numpy()
            m = np.array([75 + 25 * int(x) * total // length for x in n], np.int64)
            cut = first * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([path[a:b] for a, b in zip(cut, cut[1:])], pa.binary()),
                 pa.array([tfs[a:b] for a, b in zip(cut, cut[1:])], pa.binary()), pa.array(m)],
                ["doc_id", "path", "tfs", "m"])
    return run


# ------------------------------------------------------------------------ tree
def _gain(tf, m):
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Tree:
    """FP-tree of sorted document vectors (see the module docstring).

    ``first`` bounds each document's entries in ``term`` and ``tf``.  Nodes are runs
    ``low:high`` of documents; ``bound[node, term]`` is the largest part a document
    below can get for one occurrence of the term in an item (without w).
    """

    def __init__(self, term: np.ndarray, tf: np.ndarray, first: np.ndarray, m: np.ndarray, n_terms: int):
        self.term, self.first, self.m = term, first, m
        doc = np.repeat(np.arange(len(m)), np.diff(first))
        self.gain = _gain(tf, m[doc])
        self.low, self.high, self.children = [], [], []
        self._grow(common_beginnings(term, first))
        tf_max = np.zeros((len(self.low), n_terms), np.int32)
        self.bound = np.zeros((len(self.low), n_terms), np.int32)
        m_min = np.zeros(len(self.low), np.int64)
        for node in range(len(self.low) - 1, -1, -1):        # children come after parents
            if self.children[node]:
                tf_max[node] = tf_max[self.children[node]].max(axis=0)
                m_min[node] = m_min[self.children[node]].min()
            else:
                lo, hi = self.low[node], self.high[node]
                cells = slice(first[lo], first[hi])
                np.maximum.at(tf_max[node], term[cells], tf[cells])
                m_min[node] = m[lo:hi].min()
            self.bound[node] = _gain(tf_max[node].astype(np.int64), m_min[node])

    @staticmethod
    def _split(shared: np.ndarray, lo: int, hi: int) -> list[int]:
        """Borders of the subtrees below ``lo:hi``.  A subtree with more than half of
        the documents is replaced by its own, so the tree is at most log2 deep."""
        borders, half = {lo, hi}, max((hi - lo) // 2, LEAF)
        while hi - lo > half:
            inner = shared[lo:hi - 1]
            cuts = [lo, *(lo + 1 + np.flatnonzero(inner == inner.min())).tolist(), hi]
            borders.update(cuts)
            widest = int(np.argmax(np.diff(cuts)))
            lo, hi = cuts[widest], cuts[widest + 1]
        return sorted(borders)

    def _grow(self, shared: np.ndarray) -> None:
        self.low, self.high, self.children = [0], [len(self.m)], [[]]
        todo = [0]
        while todo:
            node = todo.pop()
            lo, hi = self.low[node], self.high[node]
            if hi - lo <= LEAF:
                continue
            cuts = self._split(shared, lo, hi)
            edge = [lo]                        # small neighbours share a leaf
            for a, b in zip(cuts, cuts[1:]):
                if b - edge[-1] > LEAF and a > edge[-1]:
                    edge.append(a)
            for a, b in zip(edge, [*edge[1:], hi]):
                self.children[node].append(len(self.low))
                todo.append(len(self.low))
                self.low.append(a)
                self.high.append(b)
                self.children.append([])

    def best(self, terms: np.ndarray, weights: np.ndarray, floor: int, offer) -> None:
        """Depth-first branch and bound for one item: ``offer(documents, scores)`` gets
        what may rank and returns the score of the last place (0: not all taken)."""
        weigh = np.zeros(self.bound.shape[1], np.int64)
        weigh[terms] = weights
        reach = lambda nodes: self.bound[np.ix_(nodes, terms)].astype(np.int64) @ weights
        stack = [(int(reach([0])[0]), 0)]
        while stack:
            bound, node = stack.pop()
            if bound < max(floor, 1):
                continue
            if self.children[node]:
                below = self.children[node]
                bounds = reach(below)
                stack += [(int(bounds[i]), below[i]) for i in np.argsort(bounds, kind="stable") if bounds[i] >= max(floor, 1)]
                continue
            lo, hi = self.low[node], self.high[node]
            cells = slice(self.first[lo], self.first[hi])
            part = np.concatenate([np.zeros(1, np.int64), np.cumsum(weigh[self.term[cells]] * self.gain[cells])])
            edge = self.first[lo:hi + 1] - self.first[lo]
            scores = part[edge[1:]] - part[edge[:-1]]
            good = np.flatnonzero(scores >= max(floor, 1))
            if len(good):
                floor = offer(lo + good, scores[good])


def _search(shared, top: int):
    """Best documents of every item among the rows of a sorted partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_terms, items = shared.value
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        kind = None

        def grow(parts: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(parts)
            path, first = _numbers(table.column("path"), ">u4")
            tf, _ = _numbers(table.column("tfs"))
            ids = table.column("doc_id").combine_chunks()
            tree = Tree(path, tf, first, table.column("m").to_numpy(), n_terms)
            for item, (terms, weights) in enumerate(items):
                def offer(docs, scores, item=item):
                    old_ids, old = kept.get(item, (ids.slice(0, 0), np.zeros(0, np.int64)))
                    both = pa.concat_arrays([old_ids, ids.take(pa.array(docs))])
                    score = np.concatenate([old, scores])
                    order = np.lexsort((_id_order(both), -score))[:top]
                    kept[item] = (both.take(pa.array(order)), score[order])
                    return int(score[order[-1]]) if len(order) == top else 0
                have = kept.get(item)
                tree.best(terms, weights, int(have[1][-1]) if have and len(have[1]) == top else 0, offer)

        part: list[pa.RecordBatch] = []
        rows = cells = 0
        most = max(4 * LEAF, min(TREE_DOCS, TREE_CELLS // max(n_terms, 1) * LEAF // 4))
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            at = 0
            while at < batch.num_rows:
                size = np.cumsum([len(x) // 4 for x in batch.column(1).slice(at, most - rows).to_pylist()])
                take = max(1, int(np.searchsorted(size, TREE_CELLS - cells, "right")))
                take = min(take, len(size))
                part.append(batch.slice(at, take))
                at, rows, cells = at + take, rows + take, cells + int(size[take - 1])
                if rows >= most or cells >= TREE_CELLS:
                    grow(part)
                    part, rows, cells = [], 0, 0
        if part:
            grow(part)
        for item, (ids, scores) in kept.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(scores), item, np.int32)), ids.cast(kind), pa.array(scores)],
                ["item", "doc_id", "score"])
    return run


def _id_order(ids: pa.Array) -> np.ndarray:
    """Rank of every id in ascending order, null last, equal ids together."""
    values = ids.dictionary_encode()
    order = pc.sort_indices(values.dictionary)
    place = np.empty(len(order) + 1, np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    place[-1] = len(order)
    return place[values.indices.fill_null(len(order)).to_numpy()]


# -------------------------------------------------------------------- operator
def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` best documents of every item
    with a score above 0, equal scores by ascending id (null ids last).

    Every row of ``items`` is an item of its own and every row of ``docs`` a
    document of its own, so repeated rows and null ids rank like others.  Null and
    empty texts have no terms: such items have no results, such documents are not
    found and not counted.  Whole texts of any length are read; empty tables give no
    rows; further columns, whatever their names, are not read.

    Items are taken in blocks of about ``block_bytes`` of text, each searched for in
    all documents; within a block their terms are broadcast.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text"),
                         F.xxhash64(F.col(item_text_col).cast("string")).alias("mark"))
    sized = stored(running_totals(asked, ["mark"], sums={"upto": F.coalesce(F.octet_length("text"), F.lit(0)) + 1},
                                  count_col="item"), "search-items")
    texts = id_and_text(docs, id_col, text_col)
    kinds = [f"item_id {sized.schema['item_id'].dataType.simpleString()}", "rank int",
             f"doc_id {texts.schema['doc_id'].dataType.simpleString()}", "score long"]
    found = spark.createDataFrame([], ", ".join(kinds))
    last = sized.agg(F.max("upto")).first()[0] or 0
    for block in range(-(-last // block_bytes)):
        part = sized.where(F.floor((F.col("upto") - 1) / block_bytes) == block)
        best = _block(texts, part.select("item", "text"), top)
        found = found.unionByName(best.join(part.select("item", "item_id"), "item").drop("item"))
    return found


def _block(texts: DataFrame, items: DataFrame, top: int) -> DataFrame:
    """``(item, rank, doc_id, score)`` of one block of items."""
    spark = texts.sparkSession
    asked = items.select("item", "text").orderBy("item").collect()       # about BLOCK_BYTES
    terms = _item_terms([r["text"] for r in asked])
    vocab = vocabulary(sorted({w for t in terms for w in t}))
    lookup = {vocab.data[s:e].tobytes(): i for i, (s, e) in enumerate(zip(vocab.starts, vocab.ends))}
    id_type = texts.schema["doc_id"].dataType.simpleString()

    shared = spark.sparkContext.broadcast(vocab)
    vectors = stored(texts.mapInArrow(_vectors(shared), f"doc_id {id_type}, n long, terms binary, tfs binary"),
                     "search-vectors")
    sums = vectors.agg(F.count(F.when(F.col("n") > 0, 1)).alias("total"), F.sum("n").alias("length")).first()
    total, length = int(sums["total"]), int(sums["length"] or 0)
    df = np.zeros(vocab.n, np.int64)
    for r in (vectors.select("terms").mapInArrow(_frequencies, "term long, df long")
              .groupBy("term").agg(F.sum("df").alias("df")).collect()):   # at most one row per term
        df[r["term"]] = r["df"]
    weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    rank = np.empty(vocab.n, np.int64)
    rank[np.lexsort((np.arange(vocab.n), -df))] = np.arange(vocab.n)

    wanted = []
    for words in terms:
        number, repeats = np.unique(np.array([lookup[w] for w in words], np.int64), return_counts=True)
        useful = weight[number] > 0
        wanted.append((rank[number[useful]], (weight[number] * repeats)[useful]))
    paths = stored(vectors.where(F.length("terms") > 0).mapInArrow(
        _paths(rank, total, max(length, 1)), f"doc_id {id_type}, path binary, tfs binary, m long"), "search-paths")
    searched = spark.sparkContext.broadcast((vocab.n, wanted))
    # Ranges by the first terms only: sampled bounds stay small, however long the vectors.
    begin = F.substring("path", 1, 4 * RANGE_TERMS)
    best = stored(paths.repartitionByRange(begin, F.xxhash64("path"), "doc_id").sortWithinPartitions("path", "doc_id")
                  .mapInArrow(_search(searched, top), f"item int, doc_id {id_type}, score long"), "search-best")
    released(vectors, paths)
    place = Window.partitionBy("at").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    number = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(asked)], "at int, item long")
    return (best.withColumnRenamed("item", "at").withColumn("rank", F.row_number().over(place))
            .where(F.col("rank") <= top).join(number, "at").select("item", "rank", "doc_id", "score"))
