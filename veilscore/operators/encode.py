"""F3 — ordinal encoding (categories sorted by code point → 0..n−1, unseen → −1).

Fit: distinct ``(feature, category)`` pairs, then an exact distributed row index
within each feature in binary string order (= code-point order).  Apply: one
left join per feature against that feature's code table (Spark broadcasts it by
its size in bytes), ``coalesce(code, -1.0)``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import row_index, written


@dataclass
class OrdinalEncoder:
    codes: DataFrame          # (feature, category, code double)
    features: list[str]

    def transform(self, df: DataFrame, unknown_value: float = -1.0) -> DataFrame:
        out = df
        for i, f in enumerate(self.features):
            key, code = f"__cat_{i}", f"__code_{i}"
            table = self.codes.where(F.col("feature") == f).select(
                F.col("category").alias(key), F.col("code").alias(code))
            out = out.join(table, out[f] == table[key], "left") \
                .withColumn(f, F.coalesce(F.col(code), F.lit(float(unknown_value)))) \
                .drop(key, code)
        return out.select(*df.columns)


def fit_ordinal_encoder(df: DataFrame, cols: Sequence[str]) -> OrdinalEncoder:
    cols = list(cols)
    spark = df.sparkSession
    if not cols:
        return OrdinalEncoder(spark.createDataFrame([], "feature string, category string, code double"), [])
    stack = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in cols)
    pairs = df.selectExpr(f"stack({len(cols)}, {stack}) AS (feature, category)") \
        .where(F.col("category").isNotNull()).distinct()
    ranked = row_index(pairs, ["category"], ["feature"], out="_rn")
    codes = written(ranked.select("feature", "category", (F.col("_rn") - 1).cast("double").alias("code")),
                    "codes")
    return OrdinalEncoder(codes, cols)
