"""Tables laid out along a space-filling curve, and boxes read by ranges of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits

#: Ranges that a box is turned into at most; more fit it closer, fewer make a shorter filter.
RANGES_MOST = 48


def write_morton(rows: DataFrame, path: str, levels: int, row_group: int = 8 << 20) -> None:
    """Rows with integer ``x, y, z`` below 2 ^ ``levels``, in the order of their Morton ``key``: files hold ranges of it, and within a
    file row groups of ``row_group`` bytes do, so their statistics tell where a box can be.

    Ranges are dealt by a sample of keys, so any share of the rows may lie in one place; equal keys stay together."""
    keyed = rows.withColumn("key", bits.morton(F.col("x"), F.col("y"), F.col("z"), levels))
    keyed.repartitionByRange("key").sortWithinPartitions("key").write.mode("error").option("parquet.block.size", row_group).parquet(path)


def key_ranges(low: tuple[int, int, int], high: tuple[int, int, int], levels: int, most: int = RANGES_MOST) -> list[tuple[int, int]]:
    """Ranges of Morton keys that hold all of a box (both corners included), ``most`` at most.

    Octants are cut as long as there is room: those wholly inside are taken, those outside dropped, the rest taken whole."""
    inside: list[tuple[int, int]] = []
    front = [(0, (0, 0, 0))]  # key prefix and corner, in order

    def merged(extra: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for a, b in sorted(inside + extra):
            if out and a <= out[-1][1] + 1:
                out[-1] = (out[-1][0], max(out[-1][1], b))
            else:
                out.append((a, b))
        return out

    whole = lambda prefix, level: (prefix << 3 * (levels - level), ((prefix + 1) << 3 * (levels - level)) - 1)
    best = merged([whole(0, 0)])
    for level in range(1, levels + 1):
        edge, after = 1 << (levels - level), []
        for prefix, corner in front:
            for k in range(8):
                at = tuple(c + (k >> i & 1) * edge for i, c in enumerate(corner))
                if any(a > h or a + edge - 1 < lo for a, lo, h in zip(at, low, high, strict=True)):
                    continue
                if all(lo <= a and a + edge - 1 <= h for a, lo, h in zip(at, low, high, strict=True)):
                    inside.append(whole(prefix << 3 | k, level))
                else:
                    after.append((prefix << 3 | k, at))
        front = after
        found = merged([whole(p, level) for p, _ in front])
        if len(found) > most:
            break
        best = found
    return best


def read_box(spark: SparkSession, path: str, low: tuple[int, int, int], high: tuple[int, int, int], levels: int, most: int = RANGES_MOST) -> DataFrame:
    """Rows of a box from a table that ``write_morton`` wrote.  The ranges of its keys are pushed down to files and row groups; an
    exact test of the coordinates follows."""
    ranges = [F.col("key").between(a, b) for a, b in key_ranges(low, high, levels, most)]
    exact = reduce(lambda a, b: a & b, [F.col(c).between(lo, hi) for c, lo, hi in zip("xyz", low, high, strict=True)])
    rows = spark.read.parquet(path)
    return rows.where(reduce(lambda a, b: a | b, ranges, F.lit(False))).where(exact).drop("key")
