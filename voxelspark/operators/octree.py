"""Linked octrees: a table of nodes built level by level, descent along its offsets, and culling that stops at what is outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits
from ..functions.geometry import Camera
from .scan import SUM, scan
from .trace import in_frustum

#: Levels of 8^k nodes are broadcast up to this one: 4,096 nodes.
BROADCAST_LEVEL = 4


def linked_nodes(cells: DataFrame, levels: int, run: int = 4096) -> DataFrame:
    """``(node_id, level, x, y, z, first_child, child_mask)`` of the octree over the cells ``(x, y, z)`` of level ``levels``.

    Level 0 is the root.  Ids go by level, then along the Morton order, so a node's children are numbered in one run: the child
    in octant k (bit k of ``child_mask``; x lowest) has the id ``first_child`` plus the number of lower bits that are set.  Leaves
    have no child.  Each level is an aggregate of the one below; ids are a scan over runs of each level's order."""
    level = cells.select("x", "y", "z").distinct().withColumn("child_mask", F.lit(0).cast("long"))
    made = []
    for k in range(levels, -1, -1):
        made.append(level.select(F.lit(k).alias("level"), "x", "y", "z", "child_mask"))
        child = bits.single_bit(bits.octant(F.col("x"), F.col("y"), F.col("z")))
        level = level.groupBy(*[F.shiftright(c, 1).alias(c) for c in "xyz"]).agg(F.bit_or(child).alias("child_mask"))
    nodes = made[0]
    for other in made[1:]:
        nodes = nodes.unionByName(other)
    nodes = nodes.withColumn("key", bits.morton(F.col("x"), F.col("y"), F.col("z"), levels))
    one, children = F.lit(1).cast("long"), F.bit_count("child_mask").cast("long")
    nodes = scan(nodes, "key", {"nth": (one, SUM), "kids": (children, SUM)}, by=("level",), run=run, bounds=(0, (1 << 3 * levels) - 1))
    counts = nodes.groupBy("level").agg(F.count("*").alias("n")).groupBy().agg(F.sort_array(F.collect_list(F.struct("level", "n"))).alias("sizes"))  # a row for each level
    nodes = nodes.crossJoin(F.broadcast(counts))
    before = lambda k: F.aggregate(F.filter("sizes", lambda s: s["level"] < k), F.lit(0).cast("long"), lambda a, s: a + s["n"])
    return nodes.select(
        (before(F.col("level")) + F.coalesce("nth", F.lit(0))).alias("node_id"), "level", "x", "y", "z",
        F.when(F.col("child_mask") != 0, before(F.col("level") + 1) + F.coalesce("kids", F.lit(0))).alias("first_child"), "child_mask",
    )


def stored(nodes: DataFrame, path: str) -> DataFrame:
    """The node table written by level and read again: each step of a descent or a cull then reads its own level."""
    nodes.hint("rebalance", "level").write.mode("error").partitionBy("level").parquet(path)
    return nodes.sparkSession.read.schema(nodes.schema).parquet(path)


def child_of(octant: Column) -> Column:
    """The id of a node's child in an octant; null if there is none."""
    bit = bits.single_bit(octant)
    return F.when(F.col("child_mask").bitwiseAND(bit) != 0, F.col("first_child") + F.bit_count(F.col("child_mask").bitwiseAND(bit - 1)))


def _of_level(nodes: DataFrame, k: int) -> DataFrame:
    level = nodes.where(F.col("level") == k)
    return F.broadcast(level) if k <= BROADCAST_LEVEL else level


def descend(samples: DataFrame, nodes: DataFrame, levels: int) -> DataFrame:
    """Samples ``(x, y, z, ...)`` with ``leaf``, the id of their leaf in the linked tree; null if the tree has none.

    One equi-join on ids for each level.  Upper levels, of 4,096 nodes at most, are broadcast."""
    rows = samples.withColumn("leaf", F.lit(0).cast("long"))
    for k in range(levels):
        links = _of_level(nodes, k).select(F.col("node_id").alias("leaf"), "first_child", "child_mask")
        shift = levels - 1 - k
        octant = bits.octant(*[F.shiftright(c, shift) for c in "xyz"])
        rows = rows.join(links, "leaf", "left").withColumn("leaf", child_of(octant)).drop("first_child", "child_mask")
    return rows


def node_box(levels: int, origin: tuple[float, float, float], size: float) -> dict[str, Column]:
    """Bounds ``x0 ... z1`` of a node, in a space where a leaf has edges of ``size`` and cell (0, 0, 0) begins at ``origin``."""
    edge = F.pow(F.lit(2.0), F.lit(levels) - F.col("level")) * size
    at = {c: F.lit(o) + F.col(c) * edge for c, o in zip("xyz", origin, strict=True)}
    return {f"{c}{k}": v + edge if k else v for c, v in at.items() for k in (0, 1)}


def frontier_cull(nodes: DataFrame, camera: Camera, levels: int, origin: tuple[float, float, float], size: float) -> DataFrame:
    """All nodes that are tested on the way down, with ``kept`` false for those wholly outside a side of the view.

    The frontier begins at the root; only kept nodes are followed to their children, by ids.  The leaves that are kept are those
    that a test of all leaves keeps, as a node's box holds its children's."""
    keep = lambda rows: rows.withColumns(node_box(levels, origin, size)).withColumn("kept", in_frustum(camera)).drop("x0", "y0", "z0", "x1", "y1", "z1")
    front = keep(nodes.where("level = 0"))
    tested = front
    for k in range(1, levels + 1):
        ids = front.where("kept and child_mask != 0").select(F.explode(F.sequence(F.col("first_child"), F.col("first_child") + F.bit_count("child_mask") - 1)).alias("node_id"))
        front = keep(_of_level(nodes, k).join(ids, "node_id") if k > BROADCAST_LEVEL else ids.join(_of_level(nodes, k), "node_id"))
        tested = tested.unionByName(front)
    return tested


def cull_by_level(tested: DataFrame) -> DataFrame:
    """Nodes tested, rejected and kept of each level."""
    return tested.groupBy("level").agg(F.count("*").alias("tested"), F.count_if(~F.col("kept")).alias("rejected"), F.count_if("kept").alias("kept"))
