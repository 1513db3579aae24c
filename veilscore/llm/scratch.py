"""Intermediate tables that outlive executors."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import clear_scratch, delete_path, scratch_path

__all__ = ["clear_scratch", "released", "stored"]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the session's shared checkpoint folder and
    read back: lineage is cut, later reads are columnar, a lost executor only
    costs a re-read.  ``clear_scratch`` deletes all such tables of an application
    once results that read from them are written."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def released(*frames: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing lazy reads any more."""
    for frame in frames:
        path = getattr(frame, "_scratch", None)
        if path:
            delete_path(frame.sparkSession, path)
