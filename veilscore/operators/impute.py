"""F1 exact median imputation, F2 constant imputation.

Fit = aggregation (one value per column), apply = projection.  The median is
exact (mean of the two middle values) and distributed — see
:func:`veilscore.operators.ranking.column_medians`; ``pyspark.ml.Imputer`` and
``F.median`` are not used (the first returns an existing element, the second
counts NaN as the largest value and keeps a whole column in one buffer).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranking import column_medians, exact_medians


def _nan_to_null(df: DataFrame, c: str) -> Column:
    col = F.col(c)
    if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(col), F.lit(None)).otherwise(col)
    return col


def to_long_form(df: DataFrame, cols: Sequence[str], group_col: str = "feature",
                 value_col: str = "value") -> DataFrame:
    """Wide numeric columns → ``(feature, value double)`` rows (nulls dropped)."""
    stack = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    return df.selectExpr(f"stack({len(cols)}, {stack}) AS ({group_col}, {value_col})") \
        .where(F.col(value_col).isNotNull())


@dataclass
class MedianImputer:
    medians: dict[str, float]
    dropped: list[str] = field(default_factory=list)

    def columns(self, df: DataFrame, cols: Sequence[str] | None = None) -> list[Column]:
        cols = [c for c in (cols or list(self.medians)) if c in self.medians]
        return [F.coalesce(_nan_to_null(df, c).cast("double"), F.lit(self.medians[c])).alias(c)
                for c in cols]

    def transform(self, df: DataFrame) -> DataFrame:
        """Apply: fill, and drop the columns that had no value at fit time."""
        keep = [F.col(c) for c in df.columns if c not in self.medians and c not in self.dropped]
        return df.select(*keep, *self.columns(df))

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(c, "median", float(m)) for c, m in self.medians.items()] + \
               [(c, "dropped", None) for c in self.dropped]
        return spark.createDataFrame(rows, "feature string, kind string, value double")


def fit_median_imputer(df: DataFrame, cols: Sequence[str]) -> MedianImputer:
    """F1 fit: two scans for all columns; a few numbers per column are all that
    reaches the driver.  A column whose bracket missed is counted bin by bin."""
    cols = list(cols)
    if not cols:
        return MedianImputer({}, [])
    got, missed = column_medians(df, cols)
    if missed:
        med = exact_medians(to_long_form(df, missed)).select("feature", "median").collect()
        got.update({r["feature"]: float(r["median"]) for r in med})
    return MedianImputer({c: got[c] for c in cols if c in got}, [c for c in cols if c not in got])


def impute_constant(cols: Sequence[str], fill: str = "MISSING") -> list[Column]:
    """categorical cells as strings, missing → ``fill``.  ``fill="nan"``
    reproduces what the reference actually executes (its string cast runs first)."""
    return [F.coalesce(F.col(c).cast("string"), F.lit(fill)).alias(c) for c in cols]
