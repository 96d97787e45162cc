"""Frames and sequences: merging blocks that persist, rebuilding frames, joining and trimming streams, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import LAST, scan

def sequence_of(frame: Column, rate: int) -> Column:
    return F.floor(frame / rate).cast("int")


def delta_ranges(frames: DataFrame, key: list[str], payload: list[str], rate: int) -> DataFrame:
    """One row for each run of consecutive frames in which a block is the same, cut at sequence bounds.

    ``frames`` has ``frame``, the key of a block and its payload.  The window is partitioned by all of them, so its groups
    have a sequence's frames at most."""
    rows = frames.withColumn("sequence_id", sequence_of(F.col("frame"), rate))
    by = ["sequence_id", *key, *payload]
    island = F.col("frame") - F.row_number().over(Window.partitionBy(*by).orderBy("frame"))
    return rows.withColumn("island", island).groupBy(*by, "island").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame")).drop("island")


def reconstruct(ranges: DataFrame) -> DataFrame:
    """All frames again: a row of ranges gives a row for each of its frames."""
    return ranges.withColumn("frame", F.explode(F.sequence("first_frame", "last_frame"))).drop("first_frame", "last_frame")


def frame_at(ranges: DataFrame, frames: DataFrame, rate: int) -> DataFrame:
    """Blocks of the given frames: an equi-join on the sequence, then the range test."""
    wanted = frames.select("frame").distinct().withColumn("sequence_id", sequence_of(F.col("frame"), rate))
    return ranges.join(wanted, "sequence_id").where("frame between first_frame and last_frame").drop("first_frame", "last_frame")


def sequence_lookup(frames: DataFrame, sequences: DataFrame, run: int = 4096) -> DataFrame:
    """The sequence of each frame: the last that starts at or before it, from ``sequences(sequence_id, start)``.

    Starts and frames are put in one order; the last start is a scan over runs of runs, no range join."""
    both = sequences.select(F.col("start").cast("long").alias("frame"), F.struct(F.col("start").cast("long").alias("start"), "sequence_id").alias("s"), F.lit(0).alias("kind")).unionByName(
        frames.select(F.col("frame").cast("long").alias("frame"), F.lit(None).cast("struct<start:bigint,sequence_id:int>").alias("s"), F.lit(1).alias("kind"))
    )
    found = scan(both, "frame", {"last": (F.col("s"), LAST)}, ties=("kind",), run=run).where("kind = 1")
    return found.select("frame", F.col("last.sequence_id").alias("sequence_id"), (F.col("frame") - F.col("last.start")).alias("frame_rank"))


def frame_changes(frames: DataFrame, key: list[str]) -> DataFrame:
    """For each frame, blocks that were not in the frame before, were, and those that have gone by the next."""
    rows = frames.select("frame", *key).distinct()
    tagged = rows.select("*", F.lit(1).alias("now"), F.lit(0).alias("was")).unionByName(rows.select((F.col("frame") + 1).alias("frame"), *key, F.lit(0).alias("now"), F.lit(1).alias("was")))
    pairs = tagged.groupBy("frame", *key).agg(F.max("now").alias("now"), F.max("was").alias("was"))
    return pairs.groupBy("frame").agg(
        F.count_if(F.expr("now = 1 and was = 0")).alias("added"), F.count_if(F.expr("now = 1 and was = 1")).alias("kept"), F.count_if(F.expr("now = 0 and was = 1")).alias("gone")
    )


#: Streams that one merge takes.
STREAMS_MOST = 16


def merge_streams(streams: DataFrame) -> DataFrame:
    """Streams one after another: sequence ids move up by the number of sequences of the streams before; more than 16 streams
    fail the query.

    ``streams`` has ``stream`` (order of the streams), ``sequence_id`` from 0, and any other columns."""
    sizes = streams.groupBy("stream").agg((F.max("sequence_id") + 1).alias("__sequences"))
    offset = F.coalesce(F.sum("__sequences").over(Window.orderBy("stream").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nth = F.row_number().over(Window.orderBy("stream"))
    full = F.raise_error(F.lit(f"more than {STREAMS_MOST} streams")).cast("long")
    offsets = sizes.select("stream", F.when(nth <= STREAMS_MOST, offset).otherwise(full).alias("__offset"))
    return streams.join(offsets, "stream").withColumn("sequence_id", (F.col("sequence_id") + F.col("__offset")).cast("int")).drop("__offset")


def trim_stream(stream: DataFrame, first: int, last: int) -> DataFrame:
    """Without the first and last sequences; ids start at 0 again."""
    count = stream.agg((F.max("sequence_id") + 1).alias("__sequences"))  # one row
    kept = stream.join(F.broadcast(count)).where(F.expr(f"sequence_id >= {first} and sequence_id < __sequences - {last}")).drop("__sequences")
    return kept.withColumn("sequence_id", (F.col("sequence_id") - first).cast("int"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, with repeats, and which side has them; empty if both are equal."""
    side = lambda x, y, name: x.exceptAll(y).withColumn("side", F.lit(name))
    return side(a, b, "left").unionByName(side(b, a, "right"))


def sequence_differences(frames: DataFrame, values: list[str], rate: int) -> DataFrame:
    """``difference`` of every sequence (left) and the next (right), by the id of the first; frames of a sequence are not told
    apart.  A sequence without rows is empty, so all of its neighbours' rows differ."""
    rows = frames.select(sequence_of(F.col("frame"), rate).alias("sequence_id"), *values)
    ends = rows.agg(F.min("sequence_id").alias("__first"), F.max("sequence_id").alias("__last"))  # one row
    rows = rows.join(F.broadcast(ends))
    left = rows.where("sequence_id < __last").drop("__first", "__last")
    right = rows.where("sequence_id > __first").withColumn("sequence_id", F.col("sequence_id") - 1).drop("__first", "__last")
    return difference(left, right)


def unchanged_frames(ranges: DataFrame) -> DataFrame:
    """How many blocks stay the same for how many frames."""
    return ranges.groupBy((F.col("last_frame") - F.col("first_frame") + 1).alias("frames")).agg(F.count("*").alias("blocks"))


def at_basis(rows: DataFrame, basis: DataFrame) -> DataFrame:
    """Positions (x, z) turned by their frame's yaw and moved to its origin, by ``basis(frame, ox, oz, yaw)``."""
    both = rows.join(basis, "frame")
    c, s = F.cos("yaw"), F.sin("yaw")
    return both.withColumns({"wx": c * F.col("x") + s * F.col("z") + F.col("ox"), "wz": c * F.col("z") - s * F.col("x") + F.col("oz")})


def upsert(meta: Column, key: Column, value: Column) -> Column:
    """A map with one key set."""
    return F.map_concat(F.map_filter(meta, lambda k, _: k != key), F.create_map(key, value))


def cut_frames(cuts: Column) -> Column:
    """Frame numbers of a list such as ``142,223``."""
    return F.transform(F.filter(F.split(cuts, ","), lambda c: F.trim(c) != ""), lambda c: F.trim(c).cast("int"))
