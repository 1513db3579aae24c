"""Integer linear scoring of whole tables.

Layouts:
* array form  — one ``array<bigint>`` feature column; the score is one
  higher-order expression (``aggregate`` over the non-zero weights), fully
  inside whole-stage codegen, no shuffle;
* wide form   — one column per feature; R5 guard per column, balanced ``+`` tree;
* tall form   — ``(id, feature_idx, x)`` rows; ``join`` with the weight table
  (size = model width, broadcast) and ``groupBy(id).sum`` with map-side partial
  aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import balanced_sum, dot, dot_unsigned, dot_wrapping, sigmoid_of_score
from ..functions.intcols import int_or_zero
from ..sources.model import LinearModel


def score_array(df: DataFrame, model: LinearModel, x_col: str = "x",
                keep: Sequence[str] = (), out: str = "score", strict: bool = True) -> DataFrame:
    """Score every row of ``df`` (array form).  A row of another width than
    the model is an error; ``strict=False`` zips and lets the shorter side win (R13)."""
    return df.select(*keep, dot(x_col, model.weights, model.bias, strict).alias(out))


def score_array_wrapping(df: DataFrame, model: LinearModel, x_col: str = "x",
                         keep: Sequence[str] = (), out: str = "score") -> DataFrame:
    """P1w: two's-complement (mod 2^64) score, as the encrypted arithmetic wraps."""
    return df.select(*keep, dot_wrapping(x_col, model.weights, model.bias).alias(out))


def dot_product_unsigned(df: DataFrame, weights: Sequence[int], x_col: str = "x",
                         keep: Sequence[str] = (), out: str = "dot") -> DataFrame:
    """Unsigned 64-bit dot product without bias; decimal(20,0) result."""
    return df.select(*keep, dot_unsigned(x_col, weights).alias(out))


def score_columns(df: DataFrame, model: LinearModel, feature_cols: Sequence[str] | None = None,
                  keep: Sequence[str] = (), out: str = "score", strict: bool = True) -> DataFrame:
    """P1 over wide integer columns by position: column i meets weight i; only
    int64 cells count (R5), the rest are 0.  Another number of columns than weights
    is an error; with ``strict=False`` the shorter side wins (R13)."""
    cols = list(feature_cols if feature_cols is not None else
                [c for c in df.columns if c not in set(keep)])
    if strict and len(cols) != model.feature_count:
        raise ValueError(f"{len(cols)} feature columns for a model of {model.feature_count} weights")
    k = min(len(cols), model.feature_count)
    terms = [int_or_zero(df, c) * F.lit(int(w)).cast("long")
             for c, w in zip(cols[:k], model.weights[:k]) if int(w) != 0]
    score = balanced_sum(terms + [F.lit(int(model.bias)).cast("long")])
    return df.select(*keep, score.alias(out))


def weights_frame(spark: SparkSession, model: LinearModel, drop_zero: bool = True) -> DataFrame:
    """The model as a ``(feature_idx, w)`` table (0-based index)."""
    rows = [(i, int(w)) for i, w in enumerate(model.weights) if (w != 0 or not drop_zero)]
    return spark.createDataFrame(rows, "feature_idx int, w bigint")


def score_tall(long_df: DataFrame, model: LinearModel, id_col: str = "id",
               idx_col: str = "feature_idx", x_col: str = "x", out: str = "score") -> DataFrame:
    """P1 in the tall layout: join the (tiny, width-bounded) weight table and sum per id.

    Rows whose features all have zero weight still get ``bias`` (left join).
    """
    spark = long_df.sparkSession
    w = F.broadcast(weights_frame(spark, model))  # size = model width, not data
    terms = (long_df.join(w, long_df[idx_col] == w["feature_idx"], "left")
             .select(F.col(id_col),
                     (F.coalesce(F.col(x_col).cast("long"), F.lit(0).cast("long"))
                      * F.coalesce(F.col("w"), F.lit(0).cast("long"))).alias("_t")))
    return terms.groupBy(id_col).agg((F.sum("_t") + F.lit(int(model.bias))).cast("long").alias(out))


def to_tall(df: DataFrame, id_col: str, x_col: str = "x") -> DataFrame:
    """Array form → tall ``(id, feature_idx, x)`` (0-based positions)."""
    return df.select(id_col, F.posexplode(x_col).alias("feature_idx", "x"))


def with_probability(df: DataFrame, model: LinearModel, score_col: str = "score",
                     out: str = "prob") -> DataFrame:
    """Class probability of an integer model = sigmoid(score / (s_w·s_x))."""
    return df.withColumn(out, sigmoid_of_score(score_col, model.probability_scale))


def flag_at_threshold(df: DataFrame, threshold: float | Column, prob_col: str = "prob",
                      out: str = "flag") -> DataFrame:
    """P5: decision ``prob >= threshold`` (the precision–recall curve convention)."""
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return df.withColumn(out, F.when(F.col(prob_col) >= thr, 1).otherwise(0))
