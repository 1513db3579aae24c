"""S1 — Parquet scans of the driver tables.

Only ``spark.read.parquet``: projection and filters written after the scan are
pushed into it by Catalyst (``ReadSchema`` / ``PushedFilters``), so callers
select the columns they need instead of reading whole rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Scan one driver table; optional column list is a projection the scan honours."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Lazy Parquet scan (never collected)."""
    return spark.read.parquet(path)
