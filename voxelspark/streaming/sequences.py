"""Streams of events as sequences, and history kept as state."""

from __future__ import annotations

import enum
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.folders import shared_folder


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream over a folder or file of Parquet events; ``ts`` becomes a timestamp, which watermarks need.

    Part files come in the order of their times of change, ``files_per_trigger`` in a batch."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        stream = stream.parquet(path)
    else:  # a stream takes folders only
        folder, _, name = path.rpartition("/")
        stream = stream.option("pathGlobFilter", name).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def sequence_counts(events: DataFrame, length: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events of each tumbling window and type; those later than the watermark are dropped by the stream."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type")
    return by.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def blend_history(events: DataFrame, blend: float, idle_ms: int | None = None) -> DataFrame:
    """The blended value of each user after each batch, kept as state; within a batch rows go by time, then id, and batches
    go as they come.  Where events have a column ``cut``, the history starts again at rows where it is true.  The state of a user
    without rows for ``idle_ms`` goes, at the next batch."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        seen, value = state.get if state.exists else (0, 0.0)
        for v, cut in zip(rows["value"], rows["cut"], strict=True):
            value = float(v) if seen == 0 or cut else value + (float(v) - value) * blend
            seen += 1
        state.update((seen, value))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"user_id": [key[0]], "seen": [seen], "value": [round(value, 6)]})

    cut = F.coalesce(F.col("cut"), F.lit(False)) if "cut" in events.columns else F.lit(False)
    rows = events.select("user_id", "ts", "event_id", "value", cut.alias("cut"))
    return rows.groupBy("user_id").applyInPandasWithState(
        fold, "user_id long, seen long, value double", "seen long, value double", "update", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    )


def run_to_end(stream: DataFrame, mode: str) -> DataFrame:
    """Take all that is there now and give the sink's rows: a Parquet table in the shared folder, a batch after the other; in
    mode ``complete`` the last batch replaces the earlier ones.  No row goes to the driver."""
    spark = stream.sparkSession
    path = shared_folder(spark, "sink")
    last: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")  # a repeated batch replaces itself
        last[:] = [number]

    sink = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}/state").foreachBatch(keep)
    sink.start().awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(stream.schema)
    return rows.parquet(f"{path}/rows/batch={last[0]}") if mode == "complete" else rows.parquet(f"{path}/rows").drop("batch")


def on_events(stream: DataFrame, mask: int, call: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Start a query that hands each batch of rows with a bit of ``mask`` in ``events`` to ``call``, with the batch's number;
    batches without such rows call nothing."""

    def each(batch: DataFrame, number: int) -> None:
        found = batch.where(F.col("events").bitwiseAND(F.lit(mask)) != 0)
        if not found.isEmpty():
            call(found, number)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()


class Availability(enum.Enum):
    """What a reader of a stream's rows finds."""

    FAILED = 0
    LOADING = 1
    SUCCEEDED = 2


def availability(query: StreamingQuery) -> Availability:
    """Failed, still loading, or all there."""
    if query.exception() is not None:
        return Availability.FAILED
    return Availability.LOADING if query.isActive else Availability.SUCCEEDED


class Encoding:
    """Work in a job group of its own, which can be waited for and cancelled; cancelled work leaves no further Spark job."""

    def __init__(self, spark: SparkSession, work: Callable[[], None]):
        self.spark, self.group, self.error = spark, "encoding-" + uuid.uuid4().hex, None

        def run() -> None:
            try:
                spark.sparkContext.setJobGroup(self.group, "encoding", interruptOnCancel=True)
                work()
            except Exception as e:  # told by ``wait``
                self.error = e

        self.thread = InheritableThread(target=run)
        self.thread.start()

    def wait(self, seconds: float | None = None) -> bool:
        """Whether the work has ended well in that time; its error is raised."""
        self.thread.join(seconds)
        if self.error is not None:
            raise self.error
        return not self.thread.is_alive()

    def cancel(self) -> None:
        self.spark.sparkContext.cancelJobGroup(self.group)
