"""Synthetic tables from expressions of a range; all but the random ones are the same on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import halton, sphere


def halton_points(ids: DataFrame) -> DataFrame:
    """``(id, x, y, z)`` in the unit cube for each ``id`` from 0, by bases 2, 3 and 5."""
    return ids.select("id", *[halton(F.col("id"), b).alias(c) for c, b in zip("xyz", (2, 3, 5), strict=True)])


def halton_directions(ids: DataFrame) -> DataFrame:
    """``(id, x, y, z)`` on the unit sphere for each ``id`` from 0."""
    p = ids.select("id", halton(F.col("id"), 2).alias("u"), halton(F.col("id"), 3).alias("v"))
    return p.select("id", *[c.alias(a) for a, c in zip("xyz", sphere(F.col("u"), F.col("v")), strict=True)])


def random_points(spark: SparkSession, n: int, seed: int) -> DataFrame:
    return spark.range(n).select("id", *[F.rand(seed + i).alias(c) for i, c in enumerate("xyz")])


def viewpoints(spark: SparkSession, cubemaps: int = 17) -> DataFrame:
    """``(view_id, cubemap, face)``: six faces for each cube map."""
    return spark.range(cubemaps * 6).select(F.col("id").cast("int").alias("view_id"), F.expr("cast(id div 6 as int)").alias("cubemap"), F.expr("cast(id % 6 as int)").alias("face"))
