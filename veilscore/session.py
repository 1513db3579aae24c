"""Session helpers: a local session for tests/bench and the checkpoint folder.

Library functions never create their own session; they take the caller's.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


# Paths handed out by scratch_path, by application.
_SCRATCH: dict[str, list[str]] = {}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "veilscore", extra_conf: dict | None = None) -> SparkSession:
    """Session for tests and local benchmarks (UI off, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("VEIL_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in (extra_conf or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names for checkpoints.

    Read from the session (``SparkContext.getCheckpointDir`` or the
    ``spark.checkpoint.dir`` setting).  Only when neither is set — local tests —
    a fresh scratch folder is created.
    """
    return ensure_checkpoint_dir(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - sessions without a SparkContext (Spark Connect)
        conf_dir = _conf(spark, "spark.checkpoint.dir")
        if not conf_dir:
            raise RuntimeError("spark.checkpoint.dir is not set for this session")
        return conf_dir
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None) or _conf(spark, "spark.checkpoint.dir")
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
    else:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; a cluster run needs a shared checkpoint folder")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="veilscore-ckpt-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique path below the checkpoint folder for written intermediate tables.

    Lazy results read from such tables; once they are written or collected,
    :func:`clear_scratch` deletes the tables of this application."""
    base = checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tables/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether anything is at a path, asked of the file system the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a table through the file system its path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete every intermediate table this application has written."""
    for path in _SCRATCH.pop(spark.sparkContext.applicationId, []):
        delete_path(spark, path)


def _conf(spark: SparkSession, key: str) -> str | None:
    try:
        value = spark.conf.get(key, None)
    except Exception:  # noqa: BLE001 - unset keys raise on some versions
        return None
    return value or None


def default_parallelism(spark: SparkSession) -> int:
    try:
        return int(spark.sparkContext.defaultParallelism)
    except Exception:  # noqa: BLE001
        return shuffle_partitions(spark)


def shuffle_partitions(spark: SparkSession) -> int:
    value = _conf(spark, "spark.sql.shuffle.partitions")
    return int(value) if value else 200
