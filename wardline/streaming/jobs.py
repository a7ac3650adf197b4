"""Streaming jobs: file source in, windowed aggregates or a merged dimension out.

State and progress live in the checkpoint below the shared folder. Every batch writes to a
path that carries its id, so a batch that is repeated after a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.sources import schemas
from wardline.sources.star import request_log
from wardline.sources.tables import latest_per_key
from wardline.sources.versions import VersionStore
from wardline.streaming import monitor


def stream_events(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """New files below a folder or matching a glob; a single file has to be given as a glob."""
    reader = spark.readStream.schema(schemas.SOURCE["events"])
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def stream_requests(spark: SparkSession, path: str, files_per_batch: int | None = None, delay: str = "24 hours") -> DataFrame:
    return monitor.with_watermark(request_log(stream_events(spark, path, files_per_batch)), delay)


def run_to_latest(result: DataFrame, folder: str, keys: Sequence[str]) -> DataFrame:
    """Runs an aggregating stream over all available input; returns the last value of each key.

    A group that got new rows is written once per batch; the highest batch holds its final state.
    """
    spark = result.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    query = (
        result.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    try:
        written = spark.read.parquet(f"{folder}/out")
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], result.schema)  # there has been no input yet
    return latest_per_key(written, list(keys), ["batch"]).drop("batch")


WINDOW = ["window_start", "window_end"]


def stream_error_rate(spark: SparkSession, path: str, folder: str, slide: str | None = None, **source) -> DataFrame:
    return run_to_latest(monitor.error_rate(stream_requests(spark, path, **source), "5 minutes", slide), folder, WINDOW)


def stream_request_rate(spark: SparkSession, path: str, folder: str, **source) -> DataFrame:
    return run_to_latest(monitor.request_rate(stream_requests(spark, path, **source)), folder, [*WINDOW, "path", "status_code"])


def stream_latency(spark: SparkSession, path: str, folder: str, **source) -> DataFrame:
    return run_to_latest(monitor.latency_buckets(stream_requests(spark, path, **source)), folder, WINDOW)


def stream_sustained(spark: SparkSession, path: str, folder: str, k: int = 3, **source) -> DataFrame:
    """Sustained alerts over the windows the stream has produced so far."""
    return monitor.sustained(stream_error_rate(spark, path, folder, **source), k)


class Dropped(NamedTuple):
    """Rows that a run of a stream left out: behind the watermark, or of a key it had already."""

    late: int
    replayed: int


def run_appended(result: DataFrame, folder: str) -> tuple[DataFrame, Dropped]:
    """Runs a stream that emits each row once; returns all rows so far and what this run dropped.

    The file sink keeps a log of its batches, so a batch that is repeated is there once. A later run goes
    on from the checkpoint: state, watermark and what has been read survive a restart. The drops are those
    of the batches whose progress the session keeps (``spark.sql.streaming.numRecentProgressUpdates``).
    """
    spark = result.sparkSession
    query = (
        result.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    states = [op for p in query.recentProgress for op in p.stateOperators]
    dropped = Dropped(
        sum(op.numRowsDroppedByWatermark for op in states),
        sum(int(op.customMetrics.get("numDroppedDuplicateRows", 0)) for op in states),
    )
    try:
        return spark.read.schema(result.schema).parquet(f"{folder}/out"), dropped
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], result.schema), dropped


def stream_sustained_runs(
    spark: SparkSession, path: str, folder: str, width: str = "5 minutes", k: int = 3, **source
) -> tuple[DataFrame, Dropped]:
    """Sustained alerts kept in the stream's own state; each comes out when its run of windows is over."""
    return run_appended(monitor.sustained_runs(stream_requests(spark, path, **source), width, k), folder)


def stream_once(
    spark: SparkSession, path: str, folder: str, keys: Sequence[str] = ("event_id",), lookback: str = "24 hours",
    files_per_batch: int | None = None,
) -> tuple[DataFrame, Dropped]:
    """Loads events of which files may come again: a key counts once within the look-back.

    Keys are kept in state for as long as the look-back of incremental loads; rows older than that are
    dropped and counted.
    """
    events = stream_events(spark, path, files_per_batch)
    events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lookback)
    return run_appended(events.dropDuplicatesWithinWatermark(list(keys)), folder)


def stream_scd2(
    source: DataFrame, folder: str, key: str, tracked: Sequence[str], schema=schemas.DIM_PATIENTS, surrogate: str = "patient_key",
    splice: bool = True,
) -> VersionStore:
    """Merges a stream of changes into the stored dimension below ``folder``, which has to exist.

    A batch that comes again after a failure is known by its id, which the commit carries. Changes that
    come late are spliced into the history (set aside without ``splice``); what cannot be applied is in
    the store's ``set_aside``, so no change vanishes.
    """
    store = VersionStore(source.sparkSession, folder, key, tracked, schema, surrogate)

    def merge(batch: DataFrame, batch_id: int) -> None:
        store.merge(batch, batch_id, splice)

    query = (
        source.writeStream.foreachBatch(merge)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return store
