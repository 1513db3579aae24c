"""M1–M6 from mergeable states: metrics of a table that arrives in parts.

The state of a part is its distinct scores with positive and negative counts.  States
are stored as one folder per part and added up by score, so the metrics of all parts
so far need no row again; putting a part a second time replaces it, so a replayed part
counts once.  Counts are whole numbers: merged states give exactly the union's metrics.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import metrics as M

_SCHEMA = "score {kind}, pos long, neg long, thr double"


def put(scored: DataFrame, path: str, part: str, label_col: str = "label", score_col: str = "score",
        threshold_col: Column | str | None = None) -> None:
    """Store the state of one part (a name of letters, digits, ``_`` and ``-``)."""
    if not re.fullmatch(r"[A-Za-z0-9_-]+", part):
        raise ValueError(f"{part!r} is no part name")
    state = M.score_counts(scored, label_col, score_col, threshold_col)
    state.withColumn("thr", F.col("thr").cast("double")).write.mode("overwrite").parquet(f"{path.rstrip('/')}/part={part}")


def merged(spark: SparkSession, path: str, kind: str = "double") -> DataFrame:
    """``(score, pos, neg, thr)`` over all parts; ``kind`` is the type of the scores."""
    states = spark.read.schema(_SCHEMA.format(kind=kind)).parquet(path)
    return states.groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.max("thr").alias("thr"))


def curve_points(spark: SparkSession, path: str, kind: str = "double") -> DataFrame:
    """Curve points of all parts, as of :func:`veilscore.operators.metrics.curve_points`."""
    return M.cumulated(merged(spark, path, kind))
