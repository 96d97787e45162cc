"""Frame metrics and input events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .scan import LAST, scan


#: Values of a frame number that one task orders for one key, however many frames the key has.
RUN = 1 << 16


def _earlier(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def edges(events: DataFrame, key: str, order: str, mask: str, run: int = RUN) -> DataFrame:
    """Bits that changed since the row before of the same key, those pressed and those released; 0 comes before the first.

    ``order`` is an integer, unique for a key.  The mask before is a scan for the last one over runs of runs, so that no task
    sorts a whole key."""
    rows = scan(events, order, {"_before": (F.when(F.col(mask).isNotNull(), F.struct(order, F.col(mask).alias("m"))), LAST)}, by=(key,), run=run)
    rows = rows.withColumn("changed", F.col(mask).bitwiseXOR(F.coalesce("_before.m", F.lit(0)))).drop("_before")
    return rows.withColumn("pressed", F.col("changed").bitwiseAND(F.col(mask))).withColumn("released", F.col("changed").bitwiseAND(F.bitwise_not(F.col(mask))))


def has_event(events: Column, mask: int, y: Column, low: float, high: float) -> Column:
    return (events.bitwiseAND(F.lit(mask)) != 0) & y.between(low, high)


def ring_markers(frames: DataFrame, key: str, size: int = 4140, run: int = RUN) -> DataFrame:
    """Least, mean and greatest draw time of the last ``size`` frames, at each frame of a key; frame ids are unique for a key.

    Work grows with the frames, not with ``size``: frames go in blocks of ``size``; a window is the end of one block and the
    beginning of the next, whose least and greatest are kept from either side; sums are differences of running sums.  Runs of
    ``run`` frame ids are numbered and summed on their own, and each row meets the row ``size`` frames before in the block that
    follows, so a task holds a run or two blocks of a key, however many frames the key has."""
    rows = frames.select(F.col(key).alias("_key"), "frame_id", "draw_us").withColumn("_run", F.expr(f"frame_id div {run}"))
    runs = rows.groupBy("_key", "_run").agg(F.count("*").alias("_rows"), F.sum("draw_us").alias("_us"))
    order = _earlier(Window.partitionBy("_key").orderBy("_run"))
    runs = runs.select(F.col("_key").alias("_of"), F.col("_run").alias("_of_run"), *[F.coalesce(F.sum(c).over(order), F.lit(0)).alias(f"{c}_past") for c in ("_rows", "_us")])
    inside = Window.partitionBy("_key", "_run").orderBy("frame_id")
    rows = rows.withColumns({"_nth": F.row_number().over(inside) - 1, "_so_far": F.sum("draw_us").over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    rows = rows.join(runs, F.col("_key").eqNullSafe(F.col("_of")) & F.col("_run").eqNullSafe(F.col("_of_run")))
    rows = rows.select("_key", "frame_id", "draw_us", (F.col("_rows_past") + F.col("_nth")).alias("_n"), (F.coalesce("_so_far", F.lit(0)) + F.col("_us_past")).alias("_sum"))
    rows = rows.withColumn("_block", F.expr(f"_n div {size}"))
    block = Window.partitionBy("_key", "_block").orderBy("_n")
    head, tail = block.rowsBetween(Window.unboundedPreceding, 0), block.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumns({f"_{f.__name__}_{side}": f("draw_us").over(w) for f in (F.min, F.max) for side, w in (("head", head), ("tail", tail))})
    rows = rows.withColumn("_in", F.explode(F.array(F.col("_block"), F.col("_block") + 1)))  # its own block and the next
    both = Window.partitionBy("_key", "_in").orderBy("_n")
    rows = rows.withColumns({"_before": F.lag("_sum", size).over(both), **{f"_{f}_past": F.lag(f"_{f}_tail", size - 1).over(both) for f in ("min", "max")}})
    count = F.least(F.col("_n") + 1, F.lit(size))
    return rows.where("_in = _block").select(
        F.col("_key").alias(key), "frame_id", (F.col("frame_id") % size).cast("int").alias("slot"), F.least("_min_head", "_min_past").alias("low"),
        F.round((F.col("_sum") - F.coalesce("_before", F.lit(0))) / count, 4).alias("mid"), F.greatest("_max_head", "_max_past").alias("high"),
    )


def hitches(frames: DataFrame, key: str, threshold_us: float) -> DataFrame:
    """Frames as slow as the threshold or slower: how many, and the worst."""
    return frames.where(F.col("draw_us") >= threshold_us).groupBy(key).agg(F.count("*").alias("hitches"), F.max("draw_us").alias("worst_us"))


def durations(frames: DataFrame, key: str) -> DataFrame:
    """Calls and mean duration."""
    return frames.groupBy(key).agg(F.count("*").alias("calls"), F.round(F.avg("draw_us"), 4).alias("mean_us"))


def mask_totals(events: DataFrame, key: str, mask: str, order: str) -> DataFrame:
    """What atomic updates of one word leave for each key: bits that all rows have, bits that some have, the least, the
    greatest, the sum, and the one that was set last by ``order``."""
    m = F.col(mask)
    return events.groupBy(key).agg(
        F.bit_and(m).alias("all_bits"), F.bit_or(m).alias("any_bits"), F.min(m).alias("least"), F.max(m).alias("greatest"), F.sum(m).alias("total"), F.max_by(m, F.col(order)).alias("last")
    )


def observed(rows: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """The same rows, and an observation that holds the number of those for which each condition is true once they have run."""
    seen = Observation(name)
    return rows.observe(seen, F.count("*").alias("seen"), *[F.count_if(c).alias(n) for n, c in counts.items()]), seen
