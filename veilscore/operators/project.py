"""Projections, casts, limits and slicing."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranking import row_index


def drop_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """R1."""
    return df.drop(*list(columns))


def label_int(col: str, df: DataFrame | None = None) -> Column:
    """R2: label cast to int; a missing label (null or NaN) raises."""
    c = F.col(col)
    missing = c.isNull()
    if df is not None and isinstance(df.schema[col].dataType, (T.DoubleType, T.FloatType)):
        missing = missing | F.isnan(c)
    return F.when(missing, F.raise_error(F.lit(f"label column {col} has a missing value"))) \
        .otherwise(c.cast("int"))


def column_roles(df: DataFrame, exclude: Iterable[str] = ()) -> tuple[list[str], list[str]]:
    """String columns are categorical, every other column numeric (bool too);
    excluded columns (id, label) are neither.  Returns (numeric, categorical)."""
    ex = set(exclude)
    cats = [f.name for f in df.schema.fields
            if f.name not in ex and isinstance(f.dataType, T.StringType)]
    nums = [f.name for f in df.schema.fields
            if f.name not in ex and not isinstance(f.dataType, T.StringType)]
    return nums, cats


def column_roles_frame(df: DataFrame, exclude: Iterable[str] = ()) -> DataFrame:
    """R3 as a frame ``(position, column, role, n_non_null)`` — one aggregate pass
    counts non-null cells per column (all-null columns are what F1 drops)."""
    spark = df.sparkSession
    nums, cats = column_roles(df, exclude)
    roles = {c: "numeric" for c in nums} | {c: "categorical" for c in cats}
    ordered = [c for c in df.columns if c in roles]
    if not ordered:
        return spark.createDataFrame([], "position int, column string, role string, n_non_null bigint")
    counts = df.agg(*[F.count(F.col(c)).alias(f"_{i}") for i, c in enumerate(ordered)])
    stack = ", ".join(f"{i}, '{c}', '{roles[c]}', `_{i}`" for i, c in enumerate(ordered))
    return counts.selectExpr(
        f"stack({len(ordered)}, {stack}) AS (position, column, role, n_non_null)")


def first_n(df: DataFrame, n: int, order_by: Sequence[str | Column]) -> DataFrame:
    """First ``min(n, available)`` rows in an explicit order
    (``TakeOrderedAndProject``: a per-task top-n, then a merge of n·tasks rows)."""
    return df.orderBy(*order_by).limit(int(n))


def batch_slices(df: DataFrame, batch_size: int, order_by: Sequence[str | Column],
                 out: str = "batch_id") -> DataFrame:
    """``batch_id = floor(row_index / B) + 1`` in ``order_by`` order; the last
    batch may be short; an empty table has no batches.  The row index is exact
    and distributed (no single-partition window)."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    idx = row_index(df, order_by, out="_row")
    return idx.withColumn(out, F.floor((F.col("_row") - 1) / F.lit(batch_size)).cast("long") + 1) \
        .drop("_row")


def table_shape(df: DataFrame) -> DataFrame:
    """``(n_rows, n_columns)`` as a one-row frame (count pushed into the scan)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")) \
        .withColumn("n_columns", F.lit(len(df.columns)).cast("long"))
