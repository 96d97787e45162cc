"""Sequences as one key frame and the changes after it, and frames rebuilt from the nearest key frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .timeline import sequence_of

KEY, ADDED, REMOVED, RECOLOURED = "key", "added", "removed", "recoloured"


def change_log(frames: DataFrame, key: list[str], payload: list[str], rate: int) -> DataFrame:
    """``(sequence_id, frame, kind, key, payload)``: all blocks of the first frame of each sequence as ``key`` rows, then for each
    later frame the blocks that were ``added``, ``removed`` (payload null) or ``recoloured`` since the frame before.

    ``frames`` has a row for each frame and block.  Blocks that stay as they are cost nothing.  One shuffle: a window holds what
    one block is in the ``rate`` frames of one sequence."""
    value = F.struct(*payload)
    same = Window.partitionBy("sequence_id", *key).orderBy("frame")
    rows = frames.select("frame", *key, *payload, sequence_of(F.col("frame"), rate).alias("sequence_id"))
    rows = rows.withColumns({"_was": F.lag(F.struct("frame", value.alias("v"))).over(same), "_next": F.lead("frame").over(same)})
    began = F.col("sequence_id") * rate
    kind = (
        F.when(F.col("frame") == began, KEY)
        .when(F.col("_was").isNull() | (F.col("_was.frame") < F.col("frame") - 1), ADDED)
        .when(~F.col("_was.v").eqNullSafe(value), RECOLOURED)
    )
    gone = (F.col("_next").isNull() | (F.col("_next") > F.col("frame") + 1)) & (F.col("frame") + 1 < began + rate)
    now = F.struct("frame", kind.alias("kind"), *payload)
    types = {f.name: f.dataType for f in frames.schema}
    after = F.struct((F.col("frame") + 1).cast(types["frame"]).alias("frame"), F.when(gone, REMOVED).alias("kind"), *[F.lit(None).cast(types[c]).alias(c) for c in payload])
    logged = rows.select("sequence_id", *key, F.explode(F.filter(F.array(now, after), lambda s: s["kind"].isNotNull())).alias("c"))
    return logged.select("sequence_id", "c.frame", "c.kind", *key, *[f"c.{c}" for c in payload])


def write_log(log: DataFrame, path: str) -> None:
    """A log as a table partitioned by sequence, so that a seek reads one partition."""
    log.hint("rebalance", "sequence_id").write.mode("error").partitionBy("sequence_id").parquet(path)


def seek(spark: SparkSession, path: str, frame: int, key: list[str], rate: int) -> DataFrame:
    """One frame from a written log: the changes of its own sequence up to it, from that sequence's key frame on."""
    sequence = frame // rate
    log = spark.read.parquet(path).where((F.col("sequence_id") == sequence) & (F.col("frame") <= frame))
    rest = [c for c in log.columns if c not in ("sequence_id", "frame", "kind", *key)]
    last = log.groupBy(*key).agg(F.max_by(F.struct("kind", *rest), "frame").alias("v")).where(F.col("v.kind") != REMOVED)
    return last.select(F.lit(frame).alias("frame"), *key, *[f"v.{c}" for c in rest])


def rebuild(log: DataFrame, key: list[str], rate: int) -> DataFrame:
    """All frames again: a change holds until the block's next one, or to the end of the sequence."""
    rest = [c for c in log.columns if c not in ("sequence_id", "frame", "kind", *key)]
    following = F.lead("frame").over(Window.partitionBy("sequence_id", *key).orderBy("frame"))
    rows = log.withColumn("_to", F.coalesce(following, F.col("sequence_id") * rate + rate) - 1).where((F.col("kind") != REMOVED) & (F.col("_to") >= F.col("frame")))
    return rows.select("sequence_id", *key, *rest, F.explode(F.sequence("frame", F.col("_to").cast(dict(log.dtypes)["frame"]))).alias("frame"))
