"""Sharding by a hierarchical weighted hash tree.

A row descends from the root: at each node every child draws a hash of the row's key and the child's name, weighted by
the child's weight (the sum of the shards below it), and the best draw wins.  The draws of other children do not change
when the weight of one does, so rows move only into a child that gained weight, or out of one that lost it; below any
other child nothing moves.  DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import Scratch

#: Rows of a shard that one task numbers.
SLOT_RUN = 2000

Rack = tuple[str, Sequence[tuple[int, int]]]  # name, (shard, weight)
Region = tuple[str, Sequence[Rack]]


def even_tree(shards: int, regions: int = 4, racks: int = 2) -> list[Region]:
    """``shards`` shards of weight 1, dealt in order to the racks of the regions; with few shards some racks stay empty."""
    n = regions * racks
    rack = [[(s, 1) for s in range(shards) if s * n // shards == k] for k in range(n)]
    return [(f"region{r}", [(f"rack{r * racks + k}", rack[r * racks + k]) for k in range(racks)]) for r in range(regions)]


def grown_tree(tree: Sequence[Region], shard: int, weight: int = 1) -> list[Region]:
    """The tree with one more shard in a region of its own, so that rows move only into it."""
    return [*tree, (f"region{len(tree)}", [(f"rack-{shard}", [(shard, weight)])])]


def _draw(key: Column, name: str, weight: int) -> Column:
    """An exponential draw of rate ``weight``; the least of several falls on each in proportion to its weight."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(name), key), 11)
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(float(weight))


def _pick(key: Column, children: Sequence[tuple[str, int]]) -> Column:
    """Index of the child with the best draw."""
    live = [(i, name, w) for i, (name, w) in enumerate(children) if w > 0]
    if not live:  # below a child of weight 0, where no row comes
        return F.lit(None).cast("int")
    if len(live) == 1:
        return F.lit(live[0][0])
    return F.array_min(F.array(*[F.struct(_draw(key, name, w).alias("d"), F.lit(i).alias("i")) for i, name, w in live]))["i"]


def _case(of: Column, values: Sequence[Column]) -> Column:
    if not values:
        return F.lit(None).cast("int")
    out = F.when(of == 0, values[0])
    for i, value in enumerate(values[1:], 1):
        out = out.when(of == i, value)
    return out


def descend(rows: DataFrame, key: Column, tree: Sequence[Region], prefix: str = "") -> DataFrame:
    """Adds ``<prefix>region``, ``<prefix>rack`` (indexes) and ``<prefix>shard``."""
    weight = lambda racks: sum(w for _, shards in racks for _, w in shards)
    region, rack, shard = f"{prefix}region", f"{prefix}rack", f"{prefix}shard"
    rows = rows.withColumn(region, _pick(key, [(f"{name}", weight(racks)) for name, racks in tree]))
    racks = [_pick(key, [(f"{name}/{k}", sum(w for _, w in shards)) for k, shards in rs]) for name, rs in tree]
    rows = rows.withColumn(rack, _case(F.col(region), racks))
    leaf = [
        _case(F.col(rack), [_case(_pick(key, [(f"{name}/{k}/{s}", w) for s, w in shards]), [F.lit(s) for s, _ in shards]) for k, shards in rs]) for name, rs in tree
    ]
    return rows.withColumn(shard, _case(F.col(region), leaf).cast("int"))


def hash_tree_shards(docs: DataFrame, tree: Sequence[Region], grown: Sequence[Region] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard of each row by its id, and a number for each row of a shard.

    Returns a row for each row of ``docs``: ``doc_id``; ``size`` (UTF-8 bytes of the text plus 1; a null text has none);
    ``text_crc32`` (unsigned, of the UTF-8 bytes; 0 for a null or empty text); ``region``, ``rack`` (indexes in the tree);
    ``shard``; ``slot`` (0, 1, ... in each shard); ``grown_shard`` (by the tree ``grown``; null without one).

    The id and the tree alone decide the shard: equal ids share one, null ids too.  Slots follow a hash of the id within a
    shard, ties by id, size and checksum; which of two identical rows comes first is open.  Empty tables give empty
    results.  Children of weight 0 get nothing.  Only the two named columns are read."""
    scratch = Scratch(docs.sparkSession, "shards")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit("slot"), F.col(id_col).cast("long")).alias("draw"),
    )
    rows = descend(rows, F.col("doc_id"), tree)
    if grown is None:
        rows = rows.withColumn("grown_shard", F.lit(None).cast("int"))
    else:
        rows = descend(rows, F.col("doc_id"), grown, "grown_").drop("grown_region", "grown_rack")
    rows = scratch.table(rows, "rows")
    counts = rows.groupBy("shard").agg(F.count("*")).collect()  # a row for each shard
    parts = F.create_map(*[F.lit(x) for shard, n in counts for x in (shard, max(1, n // SLOT_RUN))]) if counts else F.create_map(F.lit(0), F.lit(1))
    rows = rows.withColumn("part", F.pmod("draw", parts[F.col("shard")]))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = rows.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(before, F.lit(0)).alias("first"))
    nth = F.row_number().over(Window.partitionBy("shard", "part").orderBy("draw", "doc_id", "size", "text_crc32"))
    return (
        rows.withColumn("nth", nth - 1)
        .join(firsts, ["shard", "part"])
        .select("doc_id", "size", "text_crc32", "region", "rack", "shard", (F.col("first") + F.col("nth")).alias("slot"), "grown_shard")
    )
