"""Bounds and best-fitting lines of groups of points, from moments of one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import dot, normalised

FLT_MAX = 3.4028234663852886e38


def bounding_box(points: DataFrame, *key: str) -> DataFrame:
    """Least and greatest coordinates; without points (and key) the inverted box of the greatest float."""
    aggs = [F.coalesce(f(c), F.lit(v)).alias(n + c) for c in "xyz" for f, n, v in ((F.min, "min_", FLT_MAX), (F.max, "max_", -FLT_MAX))]
    return points.groupBy(*key).agg(*aggs) if key else points.agg(*aggs)


def line_2d(points: DataFrame, key: str) -> DataFrame:
    """Centre and unit direction of the least-squares line; null direction for coincident points."""
    m = points.groupBy(key).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.var_pop("x").alias("xx"), F.covar_pop("x", "y").alias("xy"), F.var_pop("y").alias("yy"))
    flat = F.col("xx") > F.col("yy")
    dx = F.when(flat, 1.0).otherwise(F.try_divide(F.col("xy"), F.col("yy")))
    dy = F.when(flat, F.try_divide(F.col("xy"), F.col("xx"))).otherwise(F.when(F.col("yy") > 0, 1.0))
    n = F.sqrt(dx * dx + dy * dy)
    return m.select(key, *[F.round(c, 4).alias(a) for c, a in ((F.col("cx"), "cx"), (F.col("cy"), "cy"), (dx / n, "dx"), (dy / n, "dy"))])


def line_3d(points: DataFrame, key: str, steps: int = 8) -> DataFrame:
    """Centre and direction of the longest axis of the covariance, by power iteration from (1, 1, 1) / sqrt 3.

    Stops for a group once a step turns the direction by less than a dot product of 0.999999; a covariance whose
    off-diagonals are nearly 0 keeps the start."""
    pairs = ("xx", "xy", "xz", "yy", "yz", "zz")
    m = points.groupBy(key).agg(*[F.avg(c).alias("c" + c) for c in "xyz"], *[F.covar_pop(p[0], p[1]).alias(p) for p in pairs])
    start = 0.5773502
    rows = m.withColumn("dx", F.lit(start)).withColumn("dy", F.lit(start)).withColumn("dz", F.lit(start))
    tiny = F.lit(True)
    for p in ("xy", "xz", "yz"):
        tiny = tiny & (F.abs(p) < 1.1920929e-07)
    rows = rows.withColumn("done", tiny)
    for _ in range(steps):
        d = tuple(F.col("d" + c) for c in "xyz")
        r = normalised(tuple(dot(tuple(F.col(p) for p in row), d) for row in (("xx", "xy", "xz"), ("xy", "yy", "yz"), ("xz", "yz", "zz"))))
        rows = rows.withColumn("r", F.struct(*[c.alias(n) for c, n in zip(r, "xyz", strict=True)]))
        turned = dot(tuple(F.col(f"r.{c}") for c in "xyz"), d)
        rows = rows.withColumns({**{f"d{c}": F.when(F.col("done"), F.col(f"d{c}")).otherwise(F.col(f"r.{c}")) for c in "xyz"}, "done": F.col("done") | (turned > 0.999999)})
    return rows.select(key, *[F.round(f"c{c}", 4).alias(f"c{c}") for c in "xyz"], *[F.round(f"d{c}", 3).alias(f"d{c}") for c in "xyz"])
