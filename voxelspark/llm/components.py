"""Connected components of a graph given as rows of links, without collecting it anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch

_EDGE = "a long, b long"


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one partition reduced, run by run, to links between a node and the smallest node it reaches."""

    def flush(parent: dict[int, int]) -> pa.RecordBatch:
        a, b = [], []
        for x in parent:
            root = x
            while parent[root] != root:
                root = parent[root]
            if root != x:
                a.append(x)
                b.append(root)
        return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    parent: dict[int, int] = {}
    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for z in (x, y):
                parent.setdefault(z, z)
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            while parent[y] != y:
                parent[y] = y = parent[parent[y]]
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > 500_000:
            yield flush(parent)
            parent = {}
    yield flush(parent)


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, label)`` for every node of ``links(a, b)`` (64-bit integers); label is the smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): a round is two group-bys and joins, and the
    number of rounds grows with the logarithm of the longest path.  Links of a node to itself and repeats are allowed;
    nulls are dropped.  An empty table gives an empty table.  Each partition first shrinks its links to a forest."""
    links = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a != b")
    edges = scratch.table(links.mapInArrow(_forest, _EDGE).distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # every a > b now; the small star hangs a's smaller neighbours and a itself on the least of them
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        after = (
            large.join(small, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a != b")
            .distinct()
        )
        after = scratch.table(after, "edges")
        mark = [t.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first() for t in (edges, after)]
        scratch.drop(edges)
        edges = after
        if mark[0] == mark[1]:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select("b", "b").distinct())
