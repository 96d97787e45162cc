"""Scene entities joined with their materials and meshes, and looked up by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a lookup gives for an unknown name: -1 as an unsigned 32-bit number.
NOT_FOUND = 4294967295


def scene(entities: DataFrame, materials: DataFrame, meshes: DataFrame) -> DataFrame:
    """Visible entities with material and mesh, by integer ids."""
    return entities.where("visible").join(materials, "material_id").join(meshes, "mesh_id")


def lookup(names: DataFrame, entities: DataFrame) -> DataFrame:
    """The least id that has a name; names that are null, empty or unknown give ``NOT_FOUND``."""
    ids = entities.where("name is not null and name != ''").groupBy("name").agg(F.min("entity_id").alias("entity_id"))
    return names.join(ids, "name", "left").withColumn("entity_id", F.coalesce("entity_id", F.lit(NOT_FOUND)))


def triangle_vertices(corners: DataFrame, positions: DataFrame, normals: DataFrame, uvs: DataFrame) -> DataFrame:
    """Corners ``(triangle, corner, position, uv, normal)`` with their attributes by id; a corner without a normal or a
    coordinate keeps nulls, one whose position is missing is dropped.

    The three tables have ``id`` and ``x, y, z``, ``nx, ny, nz``, ``u, v``; Spark broadcasts those that are small."""
    at = lambda t, name: t.withColumnRenamed("id", name)
    return corners.join(at(positions, "position"), "position").join(at(normals, "normal"), "normal", "left").join(at(uvs, "uv"), "uv", "left")


def opaque(pixels: DataFrame, alpha: str, least: float = 0.8) -> DataFrame:
    """Pixels that pass the alpha test."""
    return pixels.where(F.col(alpha) >= least)
