"""M1–M6: precision–recall curve, threshold at precision, average precision,
trapezoid PR-AUC, ROC-AUC and the metric summary — as distributed aggregations.

Scores are first collapsed to distinct values with positive/negative counts
(map-side partial aggregation: a score shared by a third of all rows becomes
one row per task).  Cumulative true/false positives at each threshold come from
:func:`~veilscore.operators.ranking.running_totals` (range-partitioned, no
global window).  Every area is then one more aggregation, because the previous
curve point is the current cumulative count minus the current increment:

* AP        = Σ_t pos_t / P · prec_t                        (step sum, M3)
* PR trap.  = Σ_t pos_t / P · (prec_t + prec_{t-1}) / 2      with prec_{-1}=1 (M4)
* ROC-AUC   = Σ_t neg_t · (2·tp_t − pos_t) / (2·P·N)         (tie-aware, M5)

A curve point is "predicted positive = score ≥ t", one point per distinct score,
plus the final (precision 1, recall 0) point.  One-class inputs give null areas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import running_totals

TARGET_PRECISION = 0.95


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def curve_points(scored: DataFrame, label_col: str = "label", score_col: str = "score",
                 threshold_col: Column | str | None = None) -> DataFrame:
    """Cumulative counts per distinct score, highest score first.

    Columns: ``score, thr, pos, neg, tp, fp, n_pos, n_neg`` where ``thr`` is the
    reported threshold (``threshold_col`` evaluated on the score's rows, default
    the score itself) and ``n_pos``/``n_neg`` are the class totals.
    """
    return cumulated(score_counts(scored, label_col, score_col, threshold_col))


def score_counts(scored: DataFrame, label_col: str = "label", score_col: str = "score",
                 threshold_col: Column | str | None = None) -> DataFrame:
    """``(score, pos, neg, thr)`` per distinct score."""
    thr = _col(threshold_col) if threshold_col is not None else F.col(score_col)
    y = F.col(label_col).cast("long")
    return scored.groupBy(F.col(score_col).alias("score")).agg(
        F.sum(y).alias("pos"), F.sum(F.lit(1) - y).alias("neg"), F.max(thr).alias("thr"))


def cumulated(counts: DataFrame) -> DataFrame:
    """Curve points from :func:`score_counts`."""
    rt = running_totals(counts, [F.col("score").desc()], [], {"tp": "pos", "fp": "neg"}, count_col=None)
    # Class totals: a one-row aggregate over the checkpointed points (two numbers).
    t = rt.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    return rt.withColumn("n_pos", F.lit(int(t["p"] or 0)).cast("long")) \
        .withColumn("n_neg", F.lit(int(t["n"] or 0)).cast("long"))


def average_precision_by(scored: DataFrame, by: str, label_col: str = "label",
                         score_col: str = "score") -> DataFrame:
    """M3 per value of ``by`` (folds, models): ``(by, average_precision)``, null
    without positives; one running-totals pass for all of them."""
    y = F.col(label_col).cast("long")
    d = scored.groupBy(by, F.col(score_col).alias("score")).agg(
        F.sum(y).alias("pos"), F.sum(F.lit(1) - y).alias("neg"))
    rt = running_totals(d, [F.col("score").desc()], [by], {"tp": "pos", "fp": "neg"}, count_col=None)
    steps = F.sum(F.col("pos") * _prec(F.col("tp"), F.col("fp")))
    return rt.groupBy(by).agg(F.try_divide(steps, F.sum("pos")).alias("average_precision"))


def _prec(tp: Column, fp: Column) -> Column:
    return F.when(tp + fp > 0, F.try_divide(tp, tp + fp))


def _rec(tp: Column, n_pos: Column) -> Column:
    return F.when(n_pos > 0, F.try_divide(tp, n_pos)).otherwise(F.lit(1.0))


def pr_curve(points: DataFrame, digits: int = 6) -> DataFrame:
    """M1: ``(thr, tp, fp, prec, rec)`` per distinct score, plus the final
    point ``(null, 0, 0, 1.0, 0.0)``."""
    tp, fp = F.col("tp"), F.col("fp")
    body = points.select(F.round("thr", digits).alias("thr"), tp.cast("long").alias("tp"),
                         fp.cast("long").alias("fp"),
                         F.round(_prec(tp, fp), digits).alias("prec"),
                         F.round(_rec(tp, F.col("n_pos")), digits).alias("rec"))
    spark = points.sparkSession
    final = spark.createDataFrame([(None, 0, 0, 1.0, 0.0)],
                                  "thr double, tp bigint, fp bigint, prec double, rec double")
    return body.unionByName(final)


def _summary(points: DataFrame, target: float) -> DataFrame:
    """One aggregation over the curve points: the three areas and the
    lowest-threshold point with precision ≥ target (struct ``b``)."""
    tp, fp, pos, neg = F.col("tp"), F.col("fp"), F.col("pos"), F.col("neg")
    n_pos, n_neg = F.col("n_pos"), F.col("n_neg")
    prec = _prec(tp, fp)
    prev = F.coalesce(_prec(tp - pos, fp - neg), F.lit(1.0))
    best = F.struct(F.col("thr").alias("thr"), prec.alias("p"), _rec(tp, n_pos).alias("r"))
    agg = points.agg(
        F.sum(F.try_divide(pos, n_pos) * prec).alias("_ap"),
        F.sum(F.try_divide(pos, n_pos) * (prec + prev) / 2.0).alias("_trap"),
        F.sum(neg * (2.0 * tp - pos)).alias("_roc"),
        F.max(n_pos).alias("n_pos"), F.max(n_neg).alias("n_neg"),
        F.min_by(best, F.when(prec >= F.lit(float(target)), F.col("score"))).alias("b"))
    n_pos, n_neg = F.coalesce(F.col("n_pos"), F.lit(0)), F.coalesce(F.col("n_neg"), F.lit(0))
    return agg.select(
        F.when(n_pos > 0, F.col("_ap")).alias("average_precision"),
        F.when(n_pos > 0, F.col("_trap")).alias("pr_auc_trapezoid"),
        F.when((n_pos > 0) & (n_neg > 0), F.try_divide(F.col("_roc"), 2.0 * n_pos * n_neg)).alias("roc_auc"),
        n_pos.cast("long").alias("n_pos"), n_neg.cast("long").alias("n_neg"), "b")


def _threshold_cols(default: tuple[float, float, float]) -> list[Column]:
    d_thr, d_p, d_r = default
    return [F.coalesce(F.col("b.thr"), F.lit(float(d_thr))).alias("thr"),
            F.coalesce(F.col("b.p"), F.lit(float(d_p))).alias("prec_at_thr"),
            F.coalesce(F.col("b.r"), F.lit(float(d_r))).alias("rec_at_thr")]


AREA_COLS = ["average_precision", "pr_auc_trapezoid", "roc_auc", "n_pos", "n_neg"]


def areas(points: DataFrame) -> DataFrame:
    """M3/M4/M5 in one aggregation: ``average_precision, pr_auc_trapezoid, roc_auc,
    n_pos, n_neg`` (areas null when a class is missing)."""
    return _summary(points, TARGET_PRECISION).select(*AREA_COLS)


def threshold_at_precision(points: DataFrame, target: float = TARGET_PRECISION,
                           default: tuple[float, float, float] = (0.5, 0.0, 0.0)) -> DataFrame:
    """M2: among curve points with precision ≥ target (final point excluded) the
    one with the highest recall — recall only grows as the threshold falls, so
    that is the lowest qualifying threshold; none → ``default``.
    Columns ``thr, prec_at_thr, rec_at_thr``."""
    return _summary(points, target).select(*_threshold_cols(default))


def threshold_smoke(points: DataFrame, target: float = TARGET_PRECISION) -> DataFrame:
    """The lowest-threshold point with precision ≥ target *including* the
    final point, which gives (1.0, 1.0, 0.0) when no scored point qualifies."""
    return threshold_at_precision(points, target, default=(1.0, 1.0, 0.0))


def metric_summary(points: DataFrame, target: float = TARGET_PRECISION) -> DataFrame:
    """M6: every metric in one row, from one aggregation."""
    return _summary(points, target).select(*AREA_COLS, *_threshold_cols((0.5, 0.0, 0.0)))


def round_all(df: DataFrame, digits: int = 6) -> DataFrame:
    from pyspark.sql import types as T
    return df.select(*[F.round(c, digits).alias(c) if isinstance(df.schema[c].dataType, T.DoubleType)
                       else F.col(c) for c in df.columns])
