"""Streaming log summaries.

Streams read append-only files (JSON lines or Parquet). Results go to a folder through
``foreachBatch``: each batch overwrites its own ``batch=`` folder, so a batch replayed after a lost
executor or driver replaces its earlier output instead of adding to it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from threading import Event

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from channelspark.session import work_path, write_text


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                pattern: str | None = None, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def status_counts(log: DataFrame) -> DataFrame:
    """Running counts per status."""
    return log.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def stage_windows(events: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Sum and count of stage durations per tumbling window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "stage").agg(
        F.sum("duration_s").alias("total_s"), F.count(F.lit(1)).alias("events")
    ).select(F.col("window.start").alias("start"), "stage", "total_s", "events")


def hardware_windows(samples: DataFrame, size: str = "1 hour", slide: str = "15 minutes",
                     late: str = "1 hour") -> DataFrame:
    """Peak memory and mean utilisation per sliding window."""
    return samples.withWatermark("ts", late).groupBy(F.window("ts", size, slide)).agg(
        F.max("rss_mb").alias("peak_rss_mb"), F.avg("util").alias("mean_util"),
        F.count(F.lit(1)).alias("samples"),
    ).select(F.col("window.start").alias("start"), "peak_rss_mb", "mean_util", "samples")


def worker_sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Closed activity sessions per worker: a gap longer than ``gap`` hints at a stall."""
    return events.withWatermark("ts", late).groupBy("worker", F.session_window("ts", gap)).agg(
        F.count(F.lit(1)).alias("events"), F.sum("duration_s").alias("busy_s")
    ).select("worker", F.col("session_window.start").alias("start"),
             F.col("session_window.end").alias("stop"), "events", "busy_s")


def first_deliveries(log: DataFrame, keys: Sequence[str], late: str = "1 hour") -> DataFrame:
    """Drop replayed log lines while their key is inside the watermark."""
    return log.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def run_available(stream: DataFrame, mode: str, path: str | None = None,
                  name: str = "stream") -> str:
    """Process everything available once; returns the folder of the batch outputs.

    Passing an earlier ``path`` resumes from its checkpoint: finished files are not read again.
    """
    path = path or work_path(stream.sparkSession, name)

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={number}")

    run_batches(stream, mode, path, sink)
    return path


class BatchLog(StreamingQueryListener):
    """Writes what each batch of one stream read and dropped, as the batch ends.

    One small file per batch, named by its number, so a batch that runs again after a restart replaces
    its entry, and neither the length of a run nor a later crash loses any. A driver that dies between
    the commit of a batch and its report leaves a gap in the numbers.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.run_id: str | None = None
        self.ended = Event()
        self.failures: list[BaseException] = []

    def onQueryStarted(self, event) -> None:  # before start() returns
        if event.name == self.path:
            self.run_id = str(event.runId)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if self.run_id != str(progress.runId):
            return
        try:
            dropped = sum(s.numRowsDroppedByWatermark for s in progress.stateOperators)
            entry = {"batch": progress.batchId, "rows": progress.numInputRows, "dropped": dropped}
            write_text(self.spark, f"{self.path}/batches/batch-{progress.batchId}.json", json.dumps(entry))
        except Exception as failure:  # noqa: BLE001 - raised by run_batches, not on Spark's listener thread
            self.failures.append(failure)

    def onQueryTerminated(self, event) -> None:
        if self.run_id == str(event.runId):
            self.ended.set()


def run_batches(stream: DataFrame, mode: str, path: str, sink: Callable[[DataFrame, int], None]) -> None:
    """Everything available through ``sink``, batch by batch, with a ``BatchLog`` beside it."""
    spark = stream.sparkSession
    log = BatchLog(spark, path)
    spark.streams.addListener(log)
    try:
        query = (
            stream.writeStream.queryName(path).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint")
            .trigger(availableNow=True).foreachBatch(sink).start()
        )
        query.awaitTermination()
        if not log.ended.wait(60):
            raise TimeoutError("the stream ended, but its last progress was not reported")
    finally:
        spark.streams.removeListener(log)
    if log.failures:
        raise log.failures[0]


def batch_log(spark: SparkSession, path: str) -> DataFrame:
    """(batch, rows, dropped) of every batch of all runs into ``path``.

    ``dropped`` is what the stateful operator turned away: rows that an aggregate had combined before
    it saw them count once. ``late_rows`` counts the rows themselves.
    """
    return spark.read.schema("batch bigint, rows bigint, dropped bigint").json(f"{path}/batches")


def dropped_late(spark: SparkSession, path: str) -> DataFrame:
    """Rows dropped behind the watermark, per batch of the runs into ``path``."""
    return batch_log(spark, path).select("batch", "dropped")


def late_rows(spark: SparkSession, path: str, current: DataFrame, counted: str) -> DataFrame:
    """One row (read, kept, late): rows read by all batches less those that ``current`` windows count.

    ``current`` holds the newest row of each window of a stream whose rows fall into one window each.
    """
    kept = current.agg(F.coalesce(F.sum(counted), F.lit(0)).alias("kept"))
    read = batch_log(spark, path).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).scalar()
    return kept.select(read.alias("read"), "kept", (read - F.col("kept")).alias("late"))


def batch_outputs(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All batch outputs with their batch number."""
    with_batch = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(with_batch).parquet(f"{path}/data")


def newest_per_key(outputs: DataFrame, keys: Sequence[str], order: Column | None = None
                   ) -> DataFrame:
    """Update-mode outputs to current values: the newest batch (or ``order``) wins per key."""
    rest = [c for c in outputs.columns if c not in (*keys, "batch")]
    newest = F.max_by(F.struct(*rest), F.col("batch") if order is None else order)
    return outputs.groupBy(*keys).agg(newest.alias("v")).select(
        *keys, *[F.col(f"v.{c}").alias(c) for c in rest]
    )


def status_changes(log: DataFrame) -> DataFrame:
    """Latest (ts, seq, status) per entity as a running maximum.

    A maximum takes a replayed line without effect and lines in any order, so nothing has to be
    remembered but one row per entity, in the state store; a batch reads and emits only its entities.
    """
    newest = F.max_by(F.struct("ts", "seq", "status"), F.struct("ts", "seq"))
    return log.groupBy("entity").agg(newest.alias("m")).select("entity", "m.ts", "m.seq", "m.status")


def latest_status(log: DataFrame, path: str | None = None) -> DataFrame:
    """Latest status per entity, ignoring replays; an earlier ``path`` resumes from its state."""
    changes = status_changes(log)
    path = run_available(changes, "update", path, "latest")
    stored = batch_outputs(log.sparkSession, path, changes.schema)
    return newest_per_key(stored, ["entity"], F.struct("ts", "seq"))


def ingest_shards(spark: SparkSession, source: str, schema: T.StructType, path: str | None = None,
                  max_files: int | None = None) -> str:
    """Pick up new shard files exactly once per checkpoint; returns the target folder."""
    shards = file_stream(spark, source, schema, max_files=max_files)
    return run_available(shards, "append", path, "ingest")
