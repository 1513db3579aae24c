"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Every document becomes a vector of statistics.  Random Fourier features
``sqrt(2 / D) cos(W x + b)`` approximate a Gaussian kernel over the standardised
vectors; the ridge solution of label on features comes from normal equations that
tasks sum over their rows and Spark sums over tasks, so only D x D sums reach the
driver.  Half of the training rows is scored with the other half's solution, and
an isotonic regression on those scores maps raw scores to probabilities.

The labelled rows are thinned to ``TRAIN_ROWS`` (by a hash of the id); statistics
and scores cover every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stored
from .stats import counted

#: Expected number of labelled rows that the classifier is fitted on.
TRAIN_ROWS = 40_000
#: Random Fourier features, ridge strength and kernel width in standard deviations.
FEATURES = 256
RIDGE = 1e-3
WIDTH = 2.5
SEED = 20_240_501
#: Share of a strictly increasing curve in the score, which orders the flat parts
#: of the isotonic fit.
SLOPE = 1e-3

_RATIO = "{k} / greatest({n}, 1)"
STATISTICS = {
    "length": "ln(1 + n_words)",
    "word_size": _RATIO.format(k="word_chars", n="n_words"),
    "symbols": "sqrt(" + _RATIO.format(k="n_symbols", n="word_chars") + ")",
    "dup_lines": "sqrt(" + _RATIO.format(k="n_dup_lines", n="n_lines") + ")",
    "repeats": "sqrt(" + _RATIO.format(k="n_repeat_words", n="n_words") + ")",
    "distinct": _RATIO.format(k="n_distinct", n="n_words"),
    "upper": "sqrt(" + _RATIO.format(k="n_upper", n="n_letters") + ")",
    "digits": "sqrt(" + _RATIO.format(k="n_digits", n="word_chars") + ")",
    "punctuation": "sqrt(" + _RATIO.format(k="n_punctuation", n="word_chars") + ")",
    "wide": _RATIO.format(k="n_wide", n="n_letters"),
    "line_words": "ln(1 + " + _RATIO.format(k="n_words", n="n_lines") + ")",
}
NAMES = list(STATISTICS)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, <STATISTICS>)`` of every row; null and empty texts have finite values."""
    return counted(docs, id_col, text_col).select(
        "doc_id", *[F.expr(how).cast("double").alias(name) for name, how in STATISTICS.items()])


@dataclass
class Classifier:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray           # statistics x features
    phase: np.ndarray
    base: float
    ridge: np.ndarray
    knots: np.ndarray             # isotonic fit: raw score -> probability
    heights: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.base + features(x, self.mean, self.spread, self.weights, self.phase) @ self.ridge

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        fitted = np.interp(raw, self.knots, self.heights)
        smooth = 1.0 / (1.0 + np.exp(-np.clip(8.0 * (raw - 0.5), -50.0, 50.0)))
        return np.clip((1.0 - SLOPE) * fitted + SLOPE * smooth, 0.0, 1.0)


def features(x, mean, spread, weights, phase) -> np.ndarray:
    z = np.clip((x - mean) / spread, -8.0, 8.0)
    return np.sqrt(2.0 / weights.shape[1]) * np.cos(z @ weights + phase)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False)
                     for n in NAMES], axis=1)


def _normal_equations(train: DataFrame, mean, spread, weights, phase, base: float) -> dict[int, np.ndarray]:
    """Per fold the summed outer products of (features, label - base): D + 1 squared."""
    side = weights.shape[1] + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, side, side))
        for batch in batches:
            z = features(_matrix(batch), mean, spread, weights, phase)
            label = batch.column(batch.schema.get_field_index("label")).to_numpy(zero_copy_only=False)
            fold = batch.column(batch.schema.get_field_index("fold")).to_numpy(zero_copy_only=False)
            z = np.column_stack((z, label - base))
            for f in (0, 1):
                total[f] += z[fold == f].T @ z[fold == f]
        for f in (0, 1):
            yield pa.RecordBatch.from_arrays(
                [pa.array([f] * side, pa.int32()), pa.array(range(side), pa.int32()),
                 pa.array(list(total[f]), pa.list_(pa.float64()))], ["fold", "i", "row"])

    parts = train.mapInArrow(run, "fold int, i int, row array<double>")
    sums = (parts.select("fold", "i", F.posexplode("row").alias("j", "v"))
            .groupBy("fold", "i", "j").agg(F.sum("v").alias("v")).toPandas())
    out = {}
    for f in (0, 1):
        one = sums[sums["fold"] == f]
        out[f] = np.zeros((side, side))
        out[f][one["i"], one["j"]] = one["v"]
    return out


def _solve(total: np.ndarray, rows: float) -> np.ndarray:
    d = total.shape[0] - 1
    return np.linalg.solve(total[:d, :d] + RIDGE * max(rows, 1.0) * np.eye(d), total[:d, d])


def train(stats: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
          allowed: Column | None = None, train_rows: int = TRAIN_ROWS) -> Classifier | None:
    """Fit on the rows of ``stats`` with a label; None without any.

    Rows with a null id or label are left out; a document with several labels
    counts once with each.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    if allowed is not None:
        known = known.filter(allowed)
    known = known.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("label"))
    n = known.count()
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(SEED)), F.lit(1 << 40)) / float(1 << 40)
    rows = (stats.join(known.filter(draw < train_rows / max(n, 1)), "doc_id")
            .withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2)).cast("int")))
    rows = stored(rows.select("fold", "label", *NAMES).coalesce(8), "quality-train")
    about = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("base"),
                     *[F.avg(c).alias(f"m_{c}") for c in NAMES],
                     *[F.stddev_pop(c).alias(f"s_{c}") for c in NAMES]).first()
    if not about["n"]:
        return None
    mean = np.array([about[f"m_{c}"] for c in NAMES])
    spread = np.maximum(np.array([about[f"s_{c}"] for c in NAMES]), 1e-3)
    rng = np.random.default_rng(SEED)
    weights = rng.normal(size=(len(NAMES), FEATURES)) / WIDTH
    phase = rng.uniform(0.0, 2.0 * np.pi, FEATURES)
    base = float(about["base"])
    sums = _normal_equations(rows, mean, spread, weights, phase, base)
    ridge = _solve(sums[0] + sums[1], about["n"])
    halves = [_solve(sums[1 - f], about["n"] / 2) for f in (0, 1)]

    def out_of_fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = features(_matrix(batch), mean, spread, weights, phase)
            fold = batch.column(batch.schema.get_field_index("fold")).to_numpy(zero_copy_only=False)
            raw = base + np.where(fold == 0, z @ halves[0], z @ halves[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(raw), batch.column(batch.schema.get_field_index("label"))], ["raw", "label"])

    scored = VectorAssembler(inputCols=["raw"], outputCol="features").transform(
        rows.mapInArrow(out_of_fold, "raw double, label double"))
    curve = IsotonicRegression(featuresCol="features", labelCol="label").fit(scored)
    knots = np.array(curve.boundaries.toArray())
    heights = np.array(curve.predictions.toArray())
    return Classifier(mean, spread, weights, phase, base, ridge, knots, heights)


def predict(stats: DataFrame, model: Classifier | None) -> DataFrame:
    """``(doc_id, score, predicted)`` for every row of ``statistics``.

    Without a model the score is 0.5.  Repeated rows get equal scores; no rows
    give no rows.
    """
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = shared.value
            if model is None:
                score = np.full(batch.num_rows, 0.5)
            else:
                score = model.score(_matrix(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                ["doc_id", "score", "predicted"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    return stats.select("doc_id", *NAMES).mapInArrow(run, f"doc_id {kind}, score double, predicted int")
