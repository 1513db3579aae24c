"""Forests and boosted trees of many candidates and folds, one fit per task.

Spark ML runs a job per level of every tree, so a search of 60 fits of up to 600
trees takes hours on any table.  Here the training rows are cut into ``BINS`` bins per
feature (one byte each) and counted: rows of equal bins, label and fold are one *cell*.
The cells are broadcast, and every fit runs in one task over all of them; fits run side
by side.  Callers use Spark ML if the cells exceed ``LOCAL_BYTES``.

The trees are those of Spark ML: variance gain on weighted rows, thresholds halfway
between values (at 1/32 quantiles of columns with more), Poisson bootstrap counts (of a
cell of n rows: the sum of n such counts, Poisson too; a binomial count without
replacement), a random subset of features per node, the first split of equal gain; boosting fits +-1
labels, then the residuals of the logistic loss, with all trees but the first times the
step size.  Draws depend on (seed, tree) and subsets on (seed, tree, node, feature)
alone, so a forest of 300 trees is the first 300 of 600 and a tree of depth 8 is the
top of one of depth 12: candidates that differ in these alone come from one fit, with
the scores they would have by themselves.  Cells are sorted, which makes results
independent of files and partitions.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import default_parallelism, scratch_path
from .scale import ScalePassthrough

BINS = 32                       # Spark ML's maxBins
#: Most memory of a fit: a byte per feature and about ROW_BYTES of working columns per cell.
LOCAL_BYTES = 256 << 20
ROW_BYTES = 64
#: Cells x trees that are grown together.
BATCH_ROWS = 200_000

_NODES = ("treeID int, nodeData struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,"
          "rawCount:bigint,gain:double,leftChild:int,rightChild:int,"
          "split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>")


@dataclass(frozen=True)
class Fit:
    """Settings that decide a fit; ``trees`` and (of forests) ``depth`` are read off it."""
    boosted: bool
    trees: int
    depth: int
    rate: float                          # rows drawn per row
    picked: int                          # features looked at per node
    leaf: int = 1                        # least rows of a leaf
    bootstrap: bool = True
    weights: tuple[float, float] = (1.0, 1.0)
    step: float = 0.1
    seed: int = 42

    def group(self) -> tuple:
        """Fits of one group are read off their largest."""
        return (self.boosted, self.depth if self.boosted else None, self.rate, self.picked, self.leaf,
                self.bootstrap, self.weights, self.step, self.seed)


def features_picked(subset: str, width: int, trees: int) -> int:
    """Features per node of Spark's ``featureSubsetStrategy`` (regression trees)."""
    if subset == "auto":
        subset = "all" if trees == 1 else "onethird"
    if subset == "all":
        return width
    share = {"sqrt": math.sqrt(width), "log2": math.log2(width) if width else 0, "onethird": width / 3.0}
    return min(width, max(1, math.ceil(share[subset] if subset in share else float(subset) * width)))


def fits_in_task(cells: int, width: int) -> bool:
    return cells * (width + ROW_BYTES) <= LOCAL_BYTES


# --------------------------------------------------------------------- random
def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _uniform(*keys) -> np.ndarray:
    """Numbers in [0, 1) that depend on the keys alone (broadcast against each other)."""
    z = np.zeros((1,), np.uint64)
    for k in keys:
        z = _mixed(z + np.asarray(k, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15))
    return (z >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


def _drawn(size: np.ndarray, fit: Fit, tree: int, bootstrap: bool) -> np.ndarray:
    """How many rows of every cell one tree is grown on."""
    if bootstrap:
        return np.random.default_rng([fit.seed, tree]).poisson(size * fit.rate).astype(np.float64)
    if fit.rate >= 1.0:
        return size.astype(np.float64)
    return np.random.default_rng([fit.seed, tree]).binomial(size, fit.rate).astype(np.float64)


# --------------------------------------------------------------------- growing
@dataclass
class Nodes:
    """Trees grown together; children have higher numbers than their parents, the right
    one follows the left one, and leaves lead to themselves."""
    tree: np.ndarray
    feature: np.ndarray                  # -1: leaf
    cut: np.ndarray                      # rows of bins up to it go left
    left: np.ndarray
    weight: np.ndarray
    total: np.ndarray
    squares: np.ndarray
    count: np.ndarray
    gain: np.ndarray

    def value(self) -> np.ndarray:
        return self.total / self.weight


def grow(x: np.ndarray, fit: Fit, trees: np.ndarray, row: np.ndarray, slot: np.ndarray, count: np.ndarray,
         y: np.ndarray) -> Nodes:
    """One tree per number in ``trees``, level by level.  ``x``: bins by feature and cell;
    ``row``, ``slot``, ``count``, ``y``: drawn cells, the position of their tree, the rows
    drawn of them and what is fitted."""
    width, w0, w1 = len(x), *fit.weights
    binary = not fit.boosted
    a = y * count
    # counts of both labels are added up at once in one double, as long as it holds them
    unit = 2.0 ** 26 if binary and len(count) and count.sum() < 2 ** 26 else 0.0
    tree, heap = trees.astype(np.int64), np.ones(len(trees), np.int64)
    out: list[tuple] = []
    made = 0
    for level in range(fit.depth + 1):
        k = len(tree)
        n = np.bincount(slot, count, k).astype(np.float64)
        s = np.bincount(slot, a, k)
        q = s * w1 if binary else np.bincount(slot, a * y, k)
        w, s = (n * w0 + s * (w1 - w0), s * w1) if binary else (n, s)
        feature, cut, gain = np.full(k, -1), np.full(k, 255), np.full(k, -1.0)
        left = made + np.arange(k)
        out.append((tree, feature, cut, left, w, s, q, n, gain))
        made += k
        if level == fit.depth:
            break
        open_ = (n >= 2 * fit.leaf) & (w > 0)
        if binary:
            open_ &= (s > 0) & (s < w)
        at = np.flatnonzero(open_)
        if not len(at):
            break
        if len(at) < k:
            dense = np.full(k, -1)
            dense[at] = np.arange(len(at))
            keep = open_[slot]
            row, slot, a, y, count = row[keep], dense[slot[keep]], a[keep], y[keep], count[keep]
        looked = np.ones((len(at), width), bool)
        if fit.picked < width:
            u = _uniform(fit.seed, tree[at, None], heap[at, None], 1 + np.arange(width)[None, :])
            looked[:] = False
            np.put_along_axis(looked, np.argsort(u, axis=1, kind="stable")[:, :fit.picked], True, axis=1)
        best, best_f, best_cut = np.full(len(at), -np.inf), np.full(len(at), -1), np.zeros(len(at), np.int64)
        base, scale = s[at] ** 2 / w[at], w[at]
        first, packed = slot * BINS, count + a * unit if unit else None
        for f in range(width):
            if not looked[:, f].any():
                continue
            part = looked[slot, f] if fit.picked * 2 <= width else slice(None)
            where = first[part] + x[f, row[part]]
            sums = [np.bincount(where, c[part], len(at) * BINS).reshape(-1, BINS)[:, :-1]
                    for c in ((packed,) if unit else (count, a))]
            if unit:
                ones = np.floor(sums[0] / unit)
                sums = [sums[0] - ones * unit, ones]
            nl, sl = (np.cumsum(c, axis=1) for c in sums)
            wl, sl = (nl * w0 + sl * (w1 - w0), sl * w1) if binary else (nl, sl)
            wr, sr, nr = w[at, None] - wl, s[at, None] - sl, n[at, None] - nl
            good = (nl >= fit.leaf) & (nr >= fit.leaf) & (nl > 0) & (nr > 0) & looked[:, f, None] & (wl > 0) & (wr > 0)
            g = np.full(wl.shape, -np.inf)
            np.divide(sl ** 2, wl, out=g, where=good)
            g += np.divide(sr ** 2, wr, out=np.zeros_like(wr), where=good)
            c = np.argmax(g, axis=1)
            top = g[np.arange(len(at)), c] - base
            # of gains that are equal but for rounding the first feature's is taken
            more = top > best + 1e-12 * (base + scale)
            best, best_f, best_cut = np.where(more, top, best), np.where(more, f, best_f), np.where(more, c, best_cut)
        split = best > 1e-12 * (base + scale)
        at_split = at[split]
        if not len(at_split):
            break
        new = np.full(len(at), -1)
        new[split] = np.arange(len(at_split))
        feature[at_split], cut[at_split], gain[at_split] = best_f[split], best_cut[split], best[split] / scale[split]
        left[at_split] = made + 2 * np.arange(len(at_split))
        keep = split[slot]
        row, slot, a, y, count = row[keep], slot[keep], a[keep], y[keep], count[keep]
        slot = 2 * new[slot] + (x[best_f[slot], row] > best_cut[slot])
        tree = np.repeat(tree[at_split], 2)
        heap = np.repeat(heap[at_split] * 2, 2) + np.tile([0, 1], len(at_split))
    return Nodes(*(np.concatenate(c) for c in zip(*out)))


def _levels(x: np.ndarray, nodes: Nodes, roots: int, depth: int) -> Iterator[np.ndarray]:
    """The node (tree, row) of every row after 0, 1, ... ``depth`` levels."""
    at = np.repeat(np.arange(roots)[:, None], x.shape[1], axis=1)
    feature = np.maximum(nodes.feature, 0)
    rows = np.arange(x.shape[1])[None, :]
    yield at
    for _ in range(depth):
        at = nodes.left[at] + (x[feature[at], rows] > nodes.cut[at])
        yield at


def forest(x: np.ndarray, y: np.ndarray, size: np.ndarray, fit: Fit, first: int = 0, last: int | None = None) -> Iterator[Nodes]:
    """The trees ``first`` to ``last`` of a forest, in batches; all cells are trained on."""
    last = fit.trees if last is None else last
    each = max(1, BATCH_ROWS // max(1, len(y)))
    for lo in range(first, last, each):
        trees = np.arange(lo, min(lo + each, last))
        drawn = np.stack([_drawn(size, fit, int(t), fit.bootstrap) for t in trees])
        slot, row = np.nonzero(drawn)
        yield grow(x, fit, trees, row, slot, drawn[slot, row], y[row])


def boosted(x: np.ndarray, y: np.ndarray, size: np.ndarray, n_train: int, fit: Fit) -> Iterator[tuple[Nodes, np.ndarray]]:
    """Each round's tree and the scores of all cells after it; the first ``n_train`` cells
    are trained on."""
    sign = 2.0 * y[:n_train] - 1.0
    score = np.zeros(len(y))
    for t in range(fit.trees):
        want = sign if t == 0 else 4.0 * sign / (1.0 + np.exp(2.0 * sign * score[:n_train]))
        drawn = _drawn(size[:n_train], fit, t, False)
        row = np.flatnonzero(drawn)
        nodes = grow(x, fit, np.array([t]), row, np.zeros(len(row), np.int64), drawn[row], want[row])
        if len(row):
            *_, at = _levels(x, nodes, 1, fit.depth)
            score += (1.0 if t == 0 else fit.step) * nodes.value()[at[0]]
        yield nodes, score


# --------------------------------------------------------------------- scoring
def average_precision(y: np.ndarray, prob: np.ndarray, size: np.ndarray) -> float | None:
    """M3 of cells in memory (equal scores are one point of the curve)."""
    positives = float((y * size).sum())
    if not positives:
        return None
    order = np.argsort(-prob, kind="stable")
    sorted_ = prob[order]
    ends = np.append(np.flatnonzero(sorted_[1:] != sorted_[:-1]), len(y) - 1)
    tp, n = np.cumsum((y * size)[order])[ends], np.cumsum(size[order])[ends]
    return float(np.sum(np.diff(tp, prepend=0.0) / positives * tp / n))


def scored(x: np.ndarray, y: np.ndarray, size: np.ndarray, held: np.ndarray, fits: Sequence[Fit]) -> list[float | None]:
    """Average precision on the held-out cells of every fit of one group."""
    if held.all() or not held.any():
        return [None] * len(fits)
    order = np.argsort(held, kind="stable")
    x, y, size, n = np.ascontiguousarray(x[:, order]), y[order].astype(np.float64), size[order], int((~held).sum())
    largest = max(fits, key=lambda f: (f.trees, f.depth))
    whole = Fit(**{**largest.__dict__, "depth": max(f.depth for f in fits)})
    got: dict[tuple[int, int], float | None] = {}
    if whole.boosted:
        for t, (_, score) in enumerate(boosted(x, y, size, n, whole), 1):
            for f in fits:
                if f.trees == t:
                    got[t, f.depth] = average_precision(y[n:], 1.0 / (1.0 + np.exp(-2.0 * score[n:])), size[n:])
        return [got[f.trees, f.depth] for f in fits]
    sums = {f.depth: np.zeros(len(y) - n) for f in fits}
    test, done = np.ascontiguousarray(x[:, n:]), 0
    for nodes in forest(np.ascontiguousarray(x[:, :n]), y[:n], size[:n], whole):
        roots = int(nodes.tree.max()) + 1 - done
        value = np.divide(nodes.total, nodes.weight, out=np.zeros_like(nodes.total), where=nodes.weight > 0)
        votes = {d: value[at] for d, at in enumerate(_levels(test, nodes, roots, whole.depth)) if d in sums}
        for t in range(roots):
            done += 1
            for d, v in votes.items():
                sums[d] += v[t]
            for f in fits:
                if f.trees == done and (done, f.depth) not in got:
                    got[done, f.depth] = average_precision(y[n:], sums[f.depth] / done, size[n:])
    return [got[f.trees, f.depth] for f in fits]


# --------------------------------------------------------------------- rows
def thresholds(df: DataFrame, cols: Sequence[str]) -> list[np.ndarray]:
    """Per column at most ``BINS - 1`` ascending cuts; a row belongs left of a cut up to
    its value."""
    few = df.select(*[F.approx_count_distinct(c).alias(str(i)) for i, c in enumerate(cols)]).first()
    small = [i for i in range(len(cols)) if few[i] <= 2 * BINS]
    values: dict[int, list] = {i: [] for i in small}
    if small:
        told = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(cols[i]).alias("v")) for i in small])).alias("c"))
        for r in told.select("c.i", "c.v").where("v is not null and not isnan(v)").distinct().collect():
            values[r["i"]].append(r["v"])
    many = [i for i in range(len(cols)) if len(values.get(i, range(BINS + 1))) > BINS]
    spread = df.select(*[F.col(cols[i]) for i in many]).approxQuantile(
        [cols[i] for i in many], [b / BINS for b in range(1, BINS + 1)], 1 / BINS ** 2) if many else []
    cuts: list[np.ndarray] = []
    for i in range(len(cols)):
        if i in many:
            v = np.unique(spread[many.index(i)])
            cuts.append(v[:-1])
        else:
            v = np.unique(values[i])
            cuts.append((v[:-1] + v[1:]) / 2)
    return cuts


def _cells(cuts: Sequence[np.ndarray]):
    """mapInArrow function: the cells of a batch (fold, label and bins, a byte each) and their rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            rows = np.empty((batch.num_rows, len(columns)), np.uint8)
            rows[:, 0], rows[:, 1] = columns[0], columns[1]
            for f, c in enumerate(cuts):
                if not np.isfinite(columns[2 + f]).all():           # as Spark ML's trees
                    raise ValueError("features hold missing or infinite values")
                rows[:, 2 + f] = np.searchsorted(c, columns[2 + f], side="left")
            order = np.lexsort(rows.T)
            rows = rows[order]
            new = np.append(True, (rows[1:] != rows[:-1]).any(axis=1))
            size = np.diff(np.append(np.flatnonzero(new), len(rows)))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows[new]], pa.binary()), pa.array(size, pa.int64())],
                                             ["cell", "n"])
    return run


@dataclass
class Binned:
    scaler: object | None
    cuts: list[np.ndarray]
    x: np.ndarray                        # bins by feature and cell
    y: np.ndarray
    fold: np.ndarray
    size: np.ndarray                     # rows of a cell


def columns_of(feature_cols: Sequence[str], scale_col: str | None) -> list[str]:
    """The assembled order of :func:`veilscore.operators.models.make_pipeline`."""
    return ([scale_col] if scale_col else []) + [c for c in feature_cols if c != scale_col]


def binned(df: DataFrame, feature_cols: Sequence[str], label_col: str, fold_col: str, scale_col: str | None,
           out: int | None) -> Binned | None:
    """The cells of all rows by the bins of the rows outside fold ``out`` (None: of all);
    None if there are more than a task should hold."""
    cols = columns_of(feature_cols, scale_col)
    rows = df.select(F.col(fold_col).cast("int").alias("_fold"), F.col(label_col).cast("int").alias("_label"),
                     *[F.col(c).cast("double").alias(c) for c in cols])
    train = rows if out is None else rows.where(F.col("_fold") != out)
    scaler = ScalePassthrough(inputCol=scale_col).fit(train) if scale_col else None
    if scaler:
        rows, train = scaler.transform(rows), scaler.transform(train)
    cuts = thresholds(train, cols)
    cells = rows.select("_fold", "_label", *cols).mapInArrow(_cells(cuts), "cell binary, n bigint")
    if not fits_in_task(cells.agg(F.approx_count_distinct("cell", 0.02)).first()[0], len(cols)):
        return None
    told = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.frombuffer(b"".join(told["cell"].to_pylist()), np.uint8).reshape(-1, len(cols) + 2).T
    order = np.lexsort(table)
    table, size = np.ascontiguousarray(table[:, order]), told["n"].to_numpy()[order]
    return Binned(scaler, cuts, table[2:], table[1], table[0], size)


# --------------------------------------------------------------------- tasks
def search(df: DataFrame, fits: dict, feature_cols: Sequence[str], label_col: str, fold_col: str,
           scale_col: str | None, keep=None) -> dict | None:
    """Scores of ``fits``: (key, fold) -> :class:`Fit`; None if a task cannot hold the
    cells.  Every group of fits is one task; ``keep`` gets the scores of every wave of
    tasks as it ends."""
    spark = df.sparkSession
    groups: dict[tuple, list] = {}
    for (key, fold), fit in fits.items():
        groups.setdefault((fold, fit.group()), []).append((key, fit))
    # the longest tasks come first
    work = sorted(([fold, *zip(*mine)] for (fold, _), mine in groups.items()),
                  key=lambda g: -max(f.trees * f.depth * (4 if f.boosted else 1) for f in g[2]))
    shared = {}
    for fold in sorted({fold for fold, _, _ in work}):
        b = binned(df, feature_cols, label_col, fold_col, scale_col, fold)
        if b is None:
            return None
        shared[fold] = spark.sparkContext.broadcast((b.x, b.y, b.size, b.fold == fold))
    scores: dict = {}
    wave = max(1, default_parallelism(spark)) if keep else len(work)
    for lo in range(0, len(work), wave):
        now = [(fold, list(f)) for fold, _, f in work[lo:lo + wave]]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    fold, mine = now[i]
                    got = scored(*shared[fold].value, mine)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i] * len(got), pa.int32()), pa.array(range(len(got)), pa.int32()), pa.array(got, pa.float64())],
                        ["task", "fit", "score"])

        told = spark.range(0, len(now), 1, len(now)).mapInArrow(run, "task int, fit int, score double").collect()
        new = {(work[lo + r["task"]][1][r["fit"]], work[lo + r["task"]][0]): r["score"] for r in told}
        if keep:
            keep(new)
        scores |= new
    for b in shared.values():
        b.destroy()
    return scores


def _node_rows(nodes: Nodes, cuts: Sequence[np.ndarray]) -> pa.RecordBatch:
    """Nodes as Spark ML saves them, numbered within their tree."""
    order = np.argsort(nodes.tree, kind="stable")
    tree = nodes.tree[order]
    local = np.empty(len(order), np.int64)
    local[order] = np.arange(len(order)) - np.searchsorted(tree, tree)
    leaf, w, s, q = nodes.feature < 0, nodes.weight, nodes.total, nodes.squares
    safe = np.where(w > 0, w, 1.0)
    rows = []
    for i in order.tolist():
        f = int(nodes.feature[i])
        to = -1 if leaf[i] else int(local[nodes.left[i]])
        rows.append({"id": int(local[i]), "prediction": float(s[i] / safe[i]),
                     "impurity": max(0.0, float(q[i] / safe[i] - (s[i] / safe[i]) ** 2)),
                     "impurityStats": [float(w[i]), float(s[i]), float(q[i])], "rawCount": int(nodes.count[i]),
                     "gain": float(nodes.gain[i]), "leftChild": to, "rightChild": to if leaf[i] else to + 1,
                     "split": {"featureIndex": f, "leftCategoriesOrThreshold": [] if leaf[i] else [float(cuts[f][nodes.cut[i]])],
                               "numCategories": -1}})
    split = pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())])
    kind = pa.struct([("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()),
                      ("impurityStats", pa.list_(pa.float64())), ("rawCount", pa.int64()), ("gain", pa.float64()),
                      ("leftChild", pa.int32()), ("rightChild", pa.int32()), ("split", split)])
    return pa.RecordBatch.from_arrays([pa.array(tree.astype(np.int32)), pa.array(rows, kind)], ["treeID", "nodeData"])


def _tree_rows(spark: SparkSession, data: Binned, fit: Fit) -> DataFrame:
    """The nodes of a fit on all cells; a forest's trees are dealt over tasks."""
    shared = spark.sparkContext.broadcast((data.x, data.y, data.size))
    cuts = data.cuts
    tasks = 1 if fit.boosted else min(fit.trees, 4 * max(1, default_parallelism(spark)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, size = shared.value
        y = y.astype(np.float64)
        for batch in batches:
            for i in batch.column(0).to_pylist():
                if fit.boosted:
                    grown = (nodes for nodes, _ in boosted(x, y, size, len(y), fit))
                else:
                    grown = forest(x, y, size, fit, i * fit.trees // tasks, (i + 1) * fit.trees // tasks)
                for nodes in grown:
                    yield _node_rows(nodes, cuts)

    return spark.range(0, tasks, 1, tasks).mapInArrow(run, _NODES)


@dataclass
class Fitted:
    """A fit on all rows whose trees lie in a table; the driver holds none of them until
    :meth:`pipeline` loads them."""
    fit: Fit
    scaler: object | None
    cols: list[str]
    path: str                            # in Spark ML's format
    model: PipelineModel | None = None

    def pipeline(self) -> PipelineModel:
        """Scaler, assembler and Spark ML model."""
        if self.model is None:
            model = (GBTClassificationModel if self.fit.boosted else RandomForestRegressionModel).load(self.path)
            assembler = VectorAssembler(inputCols=self.cols, outputCol="features", handleInvalid="keep")
            self.model = PipelineModel([*([self.scaler] if self.scaler else []), assembler, model])
        return self.model

    def scored(self, df: DataFrame, id_col: str, label_col: str, out: str = "prob") -> DataFrame:
        """P4 of every row, as the loaded model gives it."""
        spark, fit = df.sparkSession, self.fit
        n = "nodeData"
        told = spark.read.parquet(f"{self.path}/data").select(
            "treeID", f"{n}.id", f"{n}.prediction", f"{n}.leftChild", F.greatest(f"{n}.split.featureIndex", F.lit(0)),
            F.coalesce(F.try_element_at(f"{n}.split.leftCategoriesOrThreshold", F.lit(1)), F.lit(float("inf")))).toArrow()
        tree, at, value, left, feature, cut = (c.to_numpy() for c in told.columns)
        order = np.lexsort((at, tree))
        tree, value, left, feature, cut = (c[order] for c in (tree, value, left, feature, cut))
        roots = np.searchsorted(tree, np.arange(fit.trees)).astype(np.int32)
        left = np.where(left < 0, np.arange(len(left)), left + roots[tree]).astype(np.int32)
        shared = spark.sparkContext.broadcast((roots, left, feature.astype(np.int32), cut, value))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            roots, left, feature, cut, value = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, batch.num_columns)])
                rows, total = np.arange(batch.num_rows)[None, :], np.zeros(batch.num_rows)
                each = max(1, BATCH_ROWS // batch.num_rows)
                for lo in range(0, fit.trees, each):
                    node = np.repeat(roots[lo:lo + each, None], batch.num_rows, axis=1)
                    for _ in range(fit.depth):
                        node = left[node] + (x[feature[node], rows] > cut[node])
                    for t, votes in enumerate(value[node], lo):
                        total += votes * (fit.step if fit.boosted and t else 1.0)
                prob = 1.0 / (1.0 + np.exp(-2.0 * total)) if fit.boosted else total / fit.trees
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prob)], [id_col, label_col, out])

        rows = self.scaler.transform(df) if self.scaler else df
        rows = rows.select(id_col, label_col, *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(self.cols)])
        return rows.mapInArrow(run, StructType([rows.schema[0], rows.schema[1], StructField(out, DoubleType())]))


def fit_all(df: DataFrame, fit: Fit, classifier, feature_cols: Sequence[str], label_col: str, fold_col: str,
            scale_col: str | None) -> Fitted | None:
    """One fit on all rows; None if a task cannot hold the cells.  The model is written in
    Spark ML's own format; ``classifier`` gives its parameters."""
    spark = df.sparkSession
    data = binned(df, feature_cols, label_col, fold_col, scale_col, None)
    if data is None:
        return None
    cols = columns_of(feature_cols, scale_col)
    small = classifier.copy({classifier.maxIter if fit.boosted else classifier.numTrees: 1})
    weight = {} if fit.boosted else {classifier.getWeightCol(): 1.0}
    two = spark.createDataFrame([{classifier.getFeaturesCol(): Vectors.dense([0.0] * len(cols)), label_col: v, **weight}
                                 for v in (0.0, 1.0)])
    at, to = scratch_path(spark, "one-tree"), scratch_path(spark, "trees")
    small.fit(two).write().save(at)
    meta = json.loads(spark.read.text(f"{at}/metadata").first()["value"])
    meta["numTrees"] = fit.trees
    meta["paramMap"]["maxIter" if fit.boosted else "numTrees"] = fit.trees
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{to}/metadata")
    one = spark.read.parquet(f"{at}/treesMetadata")
    names = one.columns
    spark.range(fit.trees).crossJoin(one).select(
        F.col("id").cast("int").alias(names[0]), names[1],
        F.when((F.col("id") == 0) | F.lit(not fit.boosted), 1.0).otherwise(fit.step).alias(names[2])
    ).coalesce(1).write.parquet(f"{to}/treesMetadata")
    _tree_rows(spark, data, fit).write.parquet(f"{to}/data")
    return Fitted(fit, data.scaler, cols, to)
