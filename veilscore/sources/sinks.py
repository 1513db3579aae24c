"""S4–S8 sinks: Parquet, CSV, JSON, an append-only run log and fitted-parameter
artifacts.  All writes are Spark writes (distributed, to shared storage)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str) -> None:
    """Overwrite."""
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Header CSV (e.g. the search results table, one row per candidate); quotes
    in cells are doubled, outer blanks kept."""
    df.write.mode("overwrite").option("header", True).option("escape", '"') \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines (metadata / metric summary rows)."""
    df.write.mode("overwrite").json(path)


def run_id(spark: SparkSession) -> str:
    """Run id ``yyyyMMdd-HHmmss`` (as the reference names its runs)."""
    return spark.range(1).select(F.date_format(F.current_timestamp(), "yyyyMMdd-HHmmss")).first()[0]


def append_run_log(spark: SparkSession, path: str, model: str, mode: str, rid: str,
                   prauc: float | None) -> DataFrame:
    """One row per run appended to a Parquet log partitioned by model;
    ``PRAUC`` rounded to 4 places."""
    row = spark.createDataFrame(
        [(datetime.now().isoformat(), model, mode, rid, None if prauc is None else round(prauc, 4))],
        "logged_at string, model string, mode string, run_id string, PRAUC double")
    row.write.mode("append").partitionBy("model").parquet(path)
    return row


def save_artifacts(frames: dict[str, DataFrame], base: str) -> dict[str, str]:
    """Fitted parameter tables (median/mean/std per feature, category codes)
    as Parquet; returns name → path."""
    paths = {}
    for name, df in frames.items():
        p = f"{base.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(p)
        paths[name] = p
    return paths
