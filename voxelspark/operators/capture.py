"""Views that a frame is captured from, samples from the pixels of their cube faces, and colours looked up in textures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from ..sources import generators
from .sorting import at_most

#: Offsets that a capture holds at most.
OFFSETS_MOST = 32
#: Views of six faces each.
VIEWS_MOST = 6 * OFFSETS_MOST
#: Forward, right and up of the six faces of a cube.
FACES = (
    ((1, 0, 0), (0, 0, -1), (0, 1, 0)),
    ((-1, 0, 0), (0, 0, 1), (0, 1, 0)),
    ((0, 1, 0), (1, 0, 0), (0, 0, -1)),
    ((0, -1, 0), (1, 0, 0), (0, 0, 1)),
    ((0, 0, 1), (1, 0, 0), (0, 1, 0)),
    ((0, 0, -1), (-1, 0, 0), (0, 1, 0)),
)


def sample_offsets(spark: SparkSession, count: int, half: float) -> DataFrame:
    """``(id, x, y, z)`` of ``count`` places, spread by Halton points over a cube of ``2 * half`` around 0."""
    if not 0 <= count <= OFFSETS_MOST:
        raise ValueError(f"{count} offsets, {OFFSETS_MOST} at most")
    points = generators.halton_points(spark.range(count))
    return points.select("id", *[((F.col(c) * 2 - 1) * half).alias(c) for c in "xyz"])


def cube_views(offsets: DataFrame) -> DataFrame:
    """``(view_id, ox.., fx.., rx.., ux..)``: six faces for each offset, with origin, forward, right and up."""
    axes = [F.struct(F.lit(k).alias("face"), *[F.lit(float(v)).alias(f"{name}{c}") for name, axis in zip("fru", face, strict=True) for c, v in zip("xyz", axis, strict=True)]) for k, face in enumerate(FACES)]
    rows = offsets.select("id", *[F.col(c).alias(f"o{c}") for c in "xyz"], F.explode(F.array(*axes)).alias("at"))
    return rows.select((F.col("id") * len(FACES) + F.col("at.face")).cast("int").alias("view_id"), "ox", "oy", "oz", "at.*").drop("face")


def cube_face_samples(pixels: DataFrame, views: DataFrame, size: int, scale: float, bias: float, srgb: bool) -> DataFrame:
    """A sample for each pixel ``(view_id, x, y, depth, r, g, b)`` of faces of ``size`` x ``size`` pixels: ``px, py, pz`` at the
    pixel's depth, which is linear after ``scale`` and ``bias``, and its colour.

    ``srgb`` tells that colours are coded with a gamma of 2.2, which is taken off.  Pixels of no view are dropped, those whose
    depth has no linear form keep null places.  Other columns stay.  Views are broadcast; more than 192 fail the query."""
    rows = pixels.join(F.broadcast(at_most(views, VIEWS_MOST, "views")), "view_id")
    at = lambda name: tuple(F.col(f"{name}{c}") for c in "xyz")
    ray = geometry.ray(F.col("x"), F.col("y"), F.lit(1.0 / size), at("f"), at("r"), at("u"))
    place = geometry.along(at("o"), ray, geometry.linear_depth(F.col("depth"), scale, bias))
    rows = rows.withColumns(dict(zip(("px", "py", "pz"), place, strict=True)))
    if srgb:
        rows = rows.withColumns({c: geometry.colour_u8(geometry.gamma(F.col(c) / 255.0, 2.2)) for c in "rgb"})
    return rows.drop("x", "y", "depth", *[f"{name}{c}" for name in "ofru" for c in "xyz"])


def textured(points: DataFrame, texels: DataFrame, u: str, v: str, width: int, height: int) -> DataFrame:
    """Points with the colour ``r, g, b`` of the nearest texel ``(x, y, r, g, b)``, taken at the border beyond the image; a texel
    that is missing is black, a null coordinate too."""

    def texel(at: str, most: int) -> Column:
        return F.greatest(F.least(F.floor(F.col(at) * most), F.lit(most - 1)), F.lit(0)).cast("int")

    colors = texels.select(F.col("x").alias("_tx"), F.col("y").alias("_ty"), *[F.col(c).alias(f"_{c}") for c in "rgb"])
    where = points.withColumns({"_u": F.when(F.col(u).isNotNull(), texel(u, width)), "_v": F.when(F.col(v).isNotNull(), texel(v, height))})
    found = where.join(colors, (F.col("_u") == F.col("_tx")) & (F.col("_v") == F.col("_ty")), "left")
    return found.withColumns({c: F.coalesce(f"_{c}", F.lit(0)) for c in "rgb"}).drop("_u", "_v", "_tx", "_ty", "_r", "_g", "_b")


def glyph_colour(coverage: Column, rgba: tuple[Column, Column, Column, Column]) -> tuple[Column, ...]:
    """A glyph's pixel: the colour by coverage and its own alpha, added to what is below."""
    alpha = coverage * rgba[3]
    return (*[c * alpha for c in rgba[:3]], F.lit(0.0))
