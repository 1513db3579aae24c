"""S10/S11 — synthetic integer feature tables, generated in parallel.

``spark.range`` splits the id space over tasks; each cell is a seeded hash of
(seed, row id, column index), so a table is reproducible and any slice of it can
be regenerated independently (the reference's generator is unseeded).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def synthetic_features(spark: SparkSession, n_rows: int, n_features: int, lo: int = -100,
                       hi: int = 100, seed: int = 42, prefix: str = "feature_",
                       num_partitions: int | None = None, with_id: bool = False) -> DataFrame:
    """Uniform integers in [lo, hi), columns ``{prefix}0 … {prefix}{k-1}`` (bigint)."""
    if hi <= lo:
        raise ValueError("hi must be greater than lo")
    base = spark.range(0, int(n_rows), 1, num_partitions)
    span = hi - lo
    cols = [(F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.lit(i)), F.lit(span)) + F.lit(lo))
            .cast("long").alias(f"{prefix}{i}") for i in range(int(n_features))]
    return base.select(*(["id"] if with_id else []), *cols)


def synthetic_unsigned(spark: SparkSession, n_rows: int, n_features: int, seed: int = 42,
                       **kw) -> DataFrame:
    """Values in [0, 10), columns ``feat_i``."""
    return synthetic_features(spark, n_rows, n_features, 0, 10, seed, "feat_", **kw)


def as_array(df: DataFrame, prefix: str = "feature_", out: str = "x",
             keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """Wide feature columns → one ``array<bigint>`` column (positional order)."""
    cols = sorted((c for c in df.columns if c.startswith(prefix)),
                  key=lambda c: int(c[len(prefix):]))
    return df.select(*[k for k in keep if k in df.columns], F.array(*cols).alias(out))


def synthetic_array(spark: SparkSession, n_rows: int, n_features: int, lo: int = -100,
                    hi: int = 100, seed: int = 42, num_partitions: int | None = None) -> DataFrame:
    """S10 in array form ``(id, x array<bigint>)`` — same cell values as
    :func:`synthetic_features`, one higher-order expression per row (hundreds of
    wide columns would exceed the code-generation size limit)."""
    span = hi - lo
    base = spark.range(0, int(n_rows), 1, num_partitions)
    x = F.transform(F.sequence(F.lit(0), F.lit(int(n_features) - 1)),
                    lambda i: (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(span))
                               + F.lit(lo)).cast("long"))
    return base.select("id", x.alias("x"))
