"""Blocks against a view: culling, binning to tiles, nearest hits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Camera

CORNERS = [(x, y, z) for z in (0, 1) for y in (0, 1) for x in (0, 1)]


def corner(k: tuple[int, int, int]) -> tuple[Column, ...]:
    """A corner of the box (x0, y0, z0) - (x1, y1, z1)."""
    return tuple(F.col(f"{axis}{side}") for axis, side in zip("xyz", k, strict=True))


def side_planes(camera: Camera) -> dict[str, tuple[float, ...]]:
    """For each side of the view the linear form (a, b, c, d) that is above 0 outside it."""
    planes = {}
    for name, axis, sign, tan in (("right", camera.right, 1, camera.tan_x), ("left", camera.right, -1, camera.tan_x), ("top", camera.up, 1, camera.tan_y), ("bottom", camera.up, -1, camera.tan_y)):
        a = tuple(sign * v - tan * f for v, f in zip(axis, camera.forward, strict=True))
        planes[name] = (*a, -sum(v * o for v, o in zip(a, camera.origin, strict=True)))
    return planes


def beyond(plane: tuple[float, ...]) -> Column:
    """All corners of the box lie outside the plane: the least value of its form over the box is above 0.

    That is the value at the box's centre less its half extents by the size of the coefficients: no corner is spelled out."""
    form = F.lit(plane[3])
    for axis, a in zip("xyz", plane, strict=False):
        low, high = F.col(f"{axis}0"), F.col(f"{axis}1")
        form = form + (low + high) * (a / 2) - (high - low) * (abs(a) / 2)
    return form > 0


def in_frustum(camera: Camera) -> Column:
    """False only if all corners of the box lie outside one of the four side planes."""
    return reduce(lambda a, b: a & b, [~beyond(p) for p in side_planes(camera).values()])


def cull_statistics(boxes: DataFrame, camera: Camera) -> DataFrame:
    """How many boxes were seen, are beyond each side plane, and are kept."""
    sides = {name: beyond(plane) for name, plane in side_planes(camera).items()}
    return boxes.agg(F.count("*").alias("seen"), *[F.count_if(c).alias(name) for name, c in sides.items()], F.count_if(in_frustum(camera)).alias("kept"))


def with_screen_bounds(boxes: DataFrame, camera: Camera, width: int, height: int, near: float = 1e-3, far: float = 100.0) -> DataFrame:
    """Adds least and greatest pixel of the box's corners, the least w of a corner as ``depth`` and the clip-space z of that corner
    as ``z`` (0 at ``near``, w at ``far``); each corner is seen once."""
    seen = []
    for k in CORNERS:
        r, u, d = camera.view(corner(k))
        seen.append(F.struct(r.alias("r"), u.alias("u"), d.alias("d"), F.greatest(d, F.lit(near)).alias("n")))
    rows = boxes.withColumn("_seen", F.array(*seen))
    pixel = lambda c: F.struct(((c["r"] / (c["n"] * camera.tan_x) + 1) * (width / 2)).alias("x"), ((F.lit(1.0) - c["u"] / (c["n"] * camera.tan_y)) * (height / 2)).alias("y"), c["d"].alias("d"), ((c["d"] - near) * (far / (far - near))).alias("z"))
    rows = rows.withColumn("_seen", F.transform("_seen", pixel))
    rows = rows.withColumns({"min_x": F.array_min("_seen.x"), "max_x": F.array_max("_seen.x"), "min_y": F.array_min("_seen.y"), "max_y": F.array_max("_seen.y"), "_first": F.array_min(F.transform("_seen", lambda c: F.struct(c["d"], c["z"])))})
    rows = rows.withColumns({"depth": F.col("_first.d"), "z": F.col("_first.z")}).drop("_first")
    return rows.drop("_seen")


def bin_tiles(boxes: DataFrame, width: int, height: int, tile: int = 8) -> DataFrame:
    """A row for each tile that the pixel bounds (min_x ... max_y) of a box touch; boxes off the screen give none."""
    at = lambda c, most: F.floor(F.greatest(F.lit(0.0), F.least(F.col(c), F.lit(float(most - 1)))) / tile).cast("int")
    on = boxes.where(F.expr(f"max_x >= 0 and min_x < {width} and max_y >= 0 and min_y < {height}"))
    rows = on.withColumn("ty", F.explode(F.sequence(at("min_y", height), at("max_y", height))))
    return rows.withColumn("tx", F.explode(F.sequence(at("min_x", width), at("max_x", width))))


def slab(origin: tuple[str, ...], direction: tuple[str, ...]) -> tuple[Column, Column]:
    """Distances at which a ray enters and leaves the box (x0 ... z1); an axis the ray is parallel to does not bound it."""
    near, far = [], []
    for axis, o, d in zip("xyz", origin, direction, strict=True):
        a, b = (F.try_divide(F.col(f"{axis}{side}") - F.col(o), F.col(d)) for side in (0, 1))
        near.append(F.least(a, b))
        far.append(F.greatest(a, b))
    return F.greatest(*near), F.least(*far)


def nearest_hits(rays: DataFrame, boxes: DataFrame, on: list[str]) -> DataFrame:
    """The nearest box of each ray, from rays and boxes that share a tile; ties go to the least block.

    ``rays``: ray_id, ox, oy, oz, dx, dy, dz and the tile; ``boxes``: block_id, x0 ... z1 and the tile.  The join is an
    equi-join on the tile, and the nearest hit a partial and final aggregate.  A ray has one tile, and a box stands in a tile
    once, so hits are rows."""
    enter, leave = slab(("ox", "oy", "oz"), ("dx", "dy", "dz"))
    pairs = rays.join(boxes, on).withColumn("t0", F.round(enter, 6)).withColumn("t1", F.round(leave, 6)).where("t0 <= t1 and t1 >= 0")
    best = F.min(F.struct(F.greatest(F.col("t0"), F.lit(0.0)).alias("t"), F.col("block_id")))
    return pairs.groupBy("ray_id").agg(best.alias("best"), F.count("*").alias("hits")).select("ray_id", "best.block_id", "best.t", "hits")


def trace_statistics(rays: DataFrame, boxes: DataFrame, on: list[str]) -> DataFrame:
    """Work of a trace for each tile: rays, boxes, pairs that are tested, pairs that hit, and rays that hit nothing."""
    enter, leave = slab(("ox", "oy", "oz"), ("dx", "dy", "dz"))
    hit = (F.round(enter, 6) <= F.round(leave, 6)) & (F.round(leave, 6) >= 0)
    by_ray = rays.join(boxes, on).groupBy(*on, "ray_id").agg(F.count("*").alias("tested"), F.count_if(hit).alias("hit"))
    found = by_ray.groupBy(*on).agg(F.sum("tested").alias("tested"), F.sum("hit").alias("hit"), F.count_if(F.col("hit") > 0).alias("met"))
    counts = rays.groupBy(*on).agg(F.count("*").alias("rays")).join(boxes.groupBy(*on).agg(F.count("*").alias("boxes")), on, "left").join(found, on, "left").fillna(0)
    return counts.select(*on, "rays", "boxes", "tested", "hit", (F.col("rays") - F.col("met")).alias("missed"))


def overdraw(rays: DataFrame, boxes: DataFrame, on: list[str]) -> DataFrame:
    """How many rays hit how many boxes; those that hit none too."""
    hits = nearest_hits(rays, boxes, on).select("ray_id", "hits")
    return rays.select("ray_id").join(hits, "ray_id", "left").fillna(0).groupBy("hits").agg(F.count("*").alias("rays"))
