"""Sorting unique small keys by bitmap, and prefix sums.

A key sets a bit in a 32-bit word; counts of words are summed in order; a key's rank is the count of the words before and
of the lower bits of its own.  Words are few (2^14 for 19-bit keys), whatever the number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import SUM, scan

def bitmap_ranks(keys: DataFrame, key: str) -> DataFrame:
    """``(key, rank)`` of the distinct keys, ranks from 0 in ascending order."""
    words = keys.select(F.expr(f"{key} div 32").cast("int").alias("word"), F.expr(f"cast({key} % 32 as int)").alias("bit"))
    words = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    before = F.sum(F.bit_count("bits")).over(Window.orderBy("word").rowsBetween(Window.unboundedPreceding, -1))
    words = words.withColumn("before", F.coalesce(before, F.lit(0)))
    set_bits = words.withColumn("bit", F.explode(F.expr("filter(sequence(0, 31), b -> (shiftright(bits, b) & 1) = 1)")))
    rank = F.col("before") + F.bit_count(F.expr("bits & (shiftleft(1L, bit) - 1)"))
    return set_bits.select((F.col("word").cast("long") * 32 + F.col("bit")).alias(key), rank.cast("long").alias("rank"))


def running_totals(rows: DataFrame, order: str, value: str, run: int) -> DataFrame:
    """Sum of ``value`` before and at each row, by integer ``order`` (unique), by a scan over runs of runs: no task holds more
    than ``run`` rows, however many there are.  A null value adds nothing."""
    found = scan(rows, order, {"_before": (F.col(value), SUM)}, run=run)
    return found.withColumn("total", F.coalesce("_before", F.lit(0)) + F.coalesce(F.col(value), F.lit(0))).drop("_before")


def ascending(rows: DataFrame, *keys: str | Column, ties: str | None = None) -> DataFrame:
    """Rows in ascending order of columns or computed keys; ``ties`` names the column whose order equal keys keep."""
    return rows.orderBy(*keys, *([ties] if ties else []))


def at_most(rows: DataFrame, most: int, what: str) -> DataFrame:
    """The rows, if there are no more than ``most``; else the query fails.  The count is one row, joined to all."""
    text = F.concat(F.lit(f"more than {most} {what}: "), F.col("_count").cast("string"))
    count = rows.agg(F.count("*").alias("_count")).select(F.when(F.col("_count") <= most, F.lit(True)).otherwise(F.raise_error(text).cast("boolean")).alias("_fits"))
    return rows.crossJoin(F.broadcast(count)).where("_fits").drop("_fits")


def dense_ids(rows: DataFrame, kind: str, order: str, most: int, name: str = "id", run: int = 4096) -> DataFrame:
    """Ids 0, 1, ... for each kind by integer ``order`` (unique in a kind); a kind of more than ``most`` rows fails the query.

    Ids are a scan of ones over runs of runs, so that no task sorts a whole kind."""
    found = scan(rows, order, {"_before": (F.lit(1).cast("long"), SUM)}, by=(kind,), run=run)
    full = F.raise_error(F.concat(F.lit(f"more than {most} of "), F.col(kind).cast("string"))).cast("long")
    nth = F.coalesce("_before", F.lit(0))
    return found.withColumn(name, F.when(nth < most, nth).otherwise(full)).drop("_before")
