"""Plain and sealed scoring on streams.

Integer scoring (P1) and the server step of sealed scoring (E2) are per-row
column expressions with no state, so the same plans run unchanged on
``readStream``; progress and exactly-once file output come from the query's
checkpoint location, which the caller names on shared storage and keeps: a restart
goes on from it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import score as S
from ..operators import seal as E
from ..sources.model import LinearModel


def _sink(df: DataFrame, sink_path: str, checkpoint: str, available_now: bool) -> StreamingQuery:
    w = df.writeStream.format("parquet").outputMode("append") \
        .option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start(sink_path)


def score_stream(spark: SparkSession, source_path: str, schema: StructType, model: LinearModel,
                 to_features: Callable[[DataFrame], DataFrame], id_col: str, sink_path: str,
                 checkpoint: str, available_now: bool = True,
                 max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Parquet files arriving in ``source_path`` → ``(id, score)`` Parquet files."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    rows = to_features(reader.parquet(source_path))
    scored = S.score_array(rows, model, keep=[id_col])
    return _sink(scored, sink_path, checkpoint, available_now)


def sealed_score_stream(spark: SparkSession, source_path: str, schema: StructType,
                        model: LinearModel, id_col: str, sink_path: str,
                        checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Sealed rows ``(id, key_id, c)`` → sealed scores; no key material is read."""
    sealed = spark.readStream.schema(schema).parquet(source_path)
    return _sink(E.score_sealed(sealed, model, id_col), sink_path, checkpoint, available_now)


def seal_stream(spark: SparkSession, source_path: str, schema: StructType, keyring: DataFrame,
                to_features: Callable[[DataFrame], DataFrame], id_col: str, width: int,
                sink_path: str, checkpoint: str,
                available_now: bool = True) -> StreamingQuery:
    """E1/E6 on a stream: rows arriving as Parquet files are sealed (stream–static
    join with the broadcast keyring) and written as sealed Parquet files."""
    rows = to_features(spark.readStream.schema(schema).parquet(source_path))
    return _sink(E.seal(rows, keyring, id_col, width=width), sink_path, checkpoint, available_now)


def append_sealed_stream(spark: SparkSession, source_path: str, schema: StructType, keyring: DataFrame,
                         to_features: Callable[[DataFrame], DataFrame], id_col: str, width: int,
                         batch_size: int, path: str, checkpoint: str, available_now: bool = True,
                         max_files_per_trigger: int | None = None) -> StreamingQuery:
    """E6/S9 on a stream: every micro-batch is sealed and appended to the sealed set at
    ``path``; batch ids go on from one to the next, and a micro-batch that is run again
    after a failure (same epoch id) adds nothing.  One stream per ``path``."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))

    def add(rows: DataFrame, epoch: int) -> None:
        E.append_sealed_batches(rows, keyring, id_col, batch_size, width, path, epoch)

    w = to_features(reader.parquet(source_path)).writeStream.foreachBatch(add) \
        .option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
