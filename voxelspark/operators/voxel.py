"""Samples to cells, cells to 4 x 4 x 4 blocks, and the pyramid above them.

Each step is one partial and final aggregate; levels of the pyramid share a single shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def leaves(samples: DataFrame, *extra: str) -> DataFrame:
    """Count and colour sums of each cell (x, y, z), also grouped by ``extra`` columns."""
    return samples.groupBy(*extra, "x", "y", "z").agg(
        F.count("*").alias("cnt"), F.sum(F.col("r").cast("long")).alias("r_sum"), F.sum(F.col("g").cast("long")).alias("g_sum"), F.sum(F.col("b").cast("long")).alias("b_sum")
    )


def leaf_colors(cells: DataFrame) -> DataFrame:
    """Average colour of each cell, rounded down."""
    return cells.select("x", "y", "z", "cnt", *[F.expr(f"cast({c}_sum div cnt as int)").alias(c) for c in "rgb"])


def octree_levels(samples: DataFrame, levels: int) -> DataFrame:
    """Nodes and samples of every level: level 0 is the root, level ``levels`` the cells."""
    cells = samples.groupBy("x", "y", "z").agg(F.count("*").alias("n"))
    node = cells.withColumn("level", F.explode(F.array(*[F.lit(k) for k in range(levels + 1)])))
    node = node.select("level", *[F.expr(f"shiftright({c}, {levels} - level)").alias(c) for c in "xyz"], "n")
    return node.groupBy("level", "x", "y", "z").agg(F.sum("n").alias("n")).groupBy("level").agg(F.count("*").alias("nodes"), F.sum("n").alias("samples"))


def cell_in_block() -> Column:
    """0 to 63, x lowest."""
    return F.expr("(x & 3) | shiftleft(y & 3, 2) | shiftleft(z & 3, 4)")


def block_masks(cells: DataFrame, *extra: str) -> DataFrame:
    """Presence of each block's 64 cells as two 32-bit masks, and how many there are."""
    cell = cells.select(*extra, *[F.shiftright(c, 2).alias("b" + c) for c in "xyz"], cell_in_block().alias("cell"), *(["cnt"] if "cnt" in cells.columns else []))
    bit = lambda lo: F.bit_or(F.expr(f"case when cell >= {lo} and cell < {lo + 32} then shiftleft(1L, cell - {lo}) else 0L end"))
    points = [F.sum("cnt").alias("points")] if "cnt" in cells.columns else []
    out = cell.groupBy(*extra, "bx", "by", "bz").agg(bit(0).alias("presence0"), bit(32).alias("presence1"), *points)
    return out.withColumn("cells", (F.bit_count("presence0") + F.bit_count("presence1")).cast("int"))


def bucket_of(cells: Column) -> Column:
    """Class of a block by its cells: up to 4, 8, 16, 32, 64."""
    return F.when(cells <= 4, 0).when(cells <= 8, 1).when(cells <= 16, 2).when(cells <= 32, 3).otherwise(4)


def occupancy(blocks: DataFrame) -> DataFrame:
    """How many blocks hold how many cells."""
    return blocks.groupBy("cells").agg(F.count("*").alias("blocks"), F.sum("points").alias("points"))


def in_and_passed(samples: DataFrame, condition: Column) -> DataFrame:
    """Rows that came, that pass a condition, and that do not (null counts as not)."""
    return samples.agg(F.count("*").alias("seen"), F.count_if(condition).alias("passed"), F.count_if(~F.coalesce(condition, F.lit(False))).alias("failed"))
