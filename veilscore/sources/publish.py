"""Tables published as a whole: parts first, one manifest row last.

A version is a folder of named Parquet tables.  It counts only once its manifest row
is written, in a job of its own after all parts, so a run that stops between parts
leaves the earlier version in place.  One writer at a time per base folder; readers
need no lock.  Folders of runs that stopped stay unread until :func:`sweep`.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete_path, path_exists

_MANIFEST = "version long, folder string, tables array<string>, key string, first long, size long"


def manifest(spark: SparkSession, base: str) -> DataFrame:
    """The rows of complete versions (none where nothing was published)."""
    path = f"{base.rstrip('/')}/manifest"
    if not path_exists(spark, path):
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).parquet(path)


def publish(frames: Mapping[str, DataFrame], base: str, spark: SparkSession, key: str | None = None,
            first: int | None = None, size: int | None = None) -> str:
    """Write ``frames`` as the next version below ``base``; returns its folder.

    ``key``, ``first`` and ``size`` are kept in the manifest row for the caller."""
    base = base.rstrip("/")
    version, folder = begin(spark, base)
    for name, frame in frames.items():
        frame.write.parquet(f"{base}/{folder}/{name}")
    commit(spark, base, version, folder, list(frames), key, first, size)
    return f"{base}/{folder}"


def begin(spark: SparkSession, base: str) -> tuple[int, str]:
    """Number and folder name of the next version; nothing is written."""
    version = (manifest(spark, base).agg(F.max("version")).first()[0] or 0) + 1
    return version, f"v{version}-{uuid.uuid4().hex[:8]}"


def commit(spark: SparkSession, base: str, version: int, folder: str, tables: list[str],
           key: str | None = None, first: int | None = None, size: int | None = None) -> None:
    """Append the manifest row that makes a written folder count."""
    row = spark.createDataFrame([(version, folder, tables, key, first, size)], _MANIFEST)
    row.coalesce(1).write.mode("append").parquet(f"{base.rstrip('/')}/manifest")


def latest(spark: SparkSession, base: str) -> dict[str, str]:
    """Paths of the newest complete version's tables, by name."""
    row = manifest(spark, base).orderBy(F.desc("version"), "folder").first()
    if row is None:
        raise FileNotFoundError(f"nothing has been published below {base}")
    return {name: f"{base.rstrip('/')}/{row['folder']}/{name}" for name in row["tables"]}


def sweep(spark: SparkSession, base: str) -> list[str]:
    """Delete the folders that no manifest row names (runs that stopped); to be called
    while nothing is being written."""
    base = base.rstrip("/")
    root = spark._jvm.org.apache.hadoop.fs.Path(base)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    here = {s.getPath().getName() for s in files.listStatus(root) if s.isDirectory()} - {"manifest"}
    kept = {r[0] for r in manifest(spark, base).select("folder").collect()}
    for name in sorted(here - kept):
        delete_path(spark, f"{base}/{name}")
    return sorted(here - kept)
