"""Text formats: key=value lines, glyph layout, hexadecimal rows, debug geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Corner pairs of the twelve edges of a box; corner k takes bit 0 of k for x, bit 1 for y, bit 2 for z.
BOX_EDGES = tuple((a, a | bit) for bit in (1, 2, 4) for a in range(8) if not a & bit)


def key_values(line: Column) -> Column:
    """Map of a line such as ``char id=65 x=3``; words without a sign have a null value."""
    return F.str_to_map(F.trim(F.regexp_replace(line, r"\s+", " ")), F.lit(" "), F.lit("="))


def glyph_layout(lines: DataFrame, glyphs: DataFrame, key: str, text: str) -> DataFrame:
    """Each character's place on its line: the sum of the advances before it.  Unknown characters take no room.

    ``glyphs`` has ``ch`` and ``advance``; it is small and broadcast by Spark if so."""
    chars = lines.select(key, F.posexplode(F.split(text, "")).alias("at", "ch")).where("ch != ''").join(glyphs, "ch", "left")
    w = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return chars.select(key, "at", "ch", F.coalesce(F.sum("advance").over(w), F.lit(0)).cast("long").alias("pen"))


def hex_rows(blobs: DataFrame, key: str, blob: str, per_row: int = 16) -> DataFrame:
    """Rows of ``per_row`` bytes as ``0x..`` by commas; only bytes that there are."""
    rows = blobs.select(key, F.hex(blob).alias("h"), F.explode(F.expr(f"sequence(0, greatest((octet_length({blob}) + {per_row - 1}) div {per_row} - 1, 0))")).alias("row"))
    part = F.expr(f"substr(h, cast(row as int) * {2 * per_row} + 1, {2 * per_row})")
    return rows.select(key, F.col("row").cast("int").alias("row"), F.regexp_replace(part, "(..)(?!$)", "0x$1, ").alias("p")).select(
        key, "row", F.regexp_replace("p", "(..)$", "0x$1").alias("line")
    )


def box_wireframes(boxes: DataFrame, key: str) -> DataFrame:
    """The vertices of each box's twelve edges with running numbers from 1, two for each edge."""
    ends = [(k, e, v) for k, edge in enumerate(BOX_EDGES) for e, v in enumerate(edge)]
    side = lambda axis, v, bit: F.col(f"{axis}{1 if v & bit else 0}")
    vertex = F.explode(F.array(*[F.struct(F.lit(2 * k + e + 1).alias("n"), *[side(a, v, b).alias(a) for a, b in zip("xyz", (1, 2, 4), strict=True)]) for k, e, v in ends]))
    rows = boxes.select(key, vertex.alias("v")).select(key, "v.*")
    return rows.withColumn("vertex_id", F.col(key) * 24 + F.col("n")).drop("n")


def obj_vertices(vertices: DataFrame) -> DataFrame:
    """Lines of an OBJ file."""
    return vertices.select("vertex_id", F.format_string("v %.4f %.4f %.4f", F.col("x").cast("double"), F.col("y").cast("double"), F.col("z").cast("double")).alias("line"))


def _side(axis: int, high: bool) -> tuple[int, ...]:
    """The corners of one side of a box, in a ring that turns left as seen from outside; bit k of a corner is the side of axis k."""
    u, v = 1 << (axis + 1) % 3, 1 << (axis + 2) % 3
    ring = [high << axis, high << axis | u, high << axis | u | v, high << axis | v]
    return tuple(ring if high else ring[::-1])


#: Two triangles for each side, cut along a diagonal from the first corner of its ring.
BOX_TRIANGLES = tuple((r[0], r[k], r[k + 1]) for axis in range(3) for high in (False, True) for r in [_side(axis, high)] for k in (1, 2))


def box_shapes(boxes: DataFrame, key: str, wireframe: bool) -> DataFrame:
    """``(key, shape, corner, x, y, z)``: the twelve lines of each box, or its twelve triangles."""
    shapes = BOX_EDGES if wireframe else BOX_TRIANGLES
    at = lambda axis, v, bit: F.col(f"{axis}{1 if v & bit else 0}")
    rows = [
        F.struct(F.lit(k).alias("shape"), F.lit(i).alias("corner"), *[at(a, v, b).alias(a) for a, b in zip("xyz", (1, 2, 4), strict=True)])
        for k, shape in enumerate(shapes)
        for i, v in enumerate(shape)
    ]
    return boxes.select(key, F.explode(F.array(*rows)).alias("v")).select(key, "v.*")


def point_shapes(points: DataFrame, key: str) -> DataFrame:
    """Each point as a shape of one corner."""
    return points.select(key, F.lit(0).alias("shape"), F.lit(0).alias("corner"), "x", "y", "z")


def obj_shapes(shapes: DataFrame, key: str, corners: int, per_key: int) -> DataFrame:
    """Lines of an OBJ file for shapes of so many corners (1 points, 2 lines, 3 triangles), ``per_key`` of them for each integer
    key from 0: an object with its material, then the vertices of each shape and its face, by ``(key, line)``.

    Vertex ids run on from object to object, as arithmetic on the key; nothing is numbered by a global sort."""
    first = F.col(key) * (corners * per_key) + F.col("shape") * corners + 1
    vertex = shapes.select(key, (F.col("shape") * (corners + 1) + F.col("corner") + 2).cast("int").alias("line"), F.concat(F.lit("v "), F.concat_ws(" ", *[F.format_string("%.4f", F.col(c).cast("double")) for c in "xyz"])).alias("text"))
    face = shapes.where("corner = 0").select(
        key, (F.col("shape") * (corners + 1) + corners + 2).cast("int").alias("line"), F.concat(F.lit("f "), F.concat_ws(" ", *[(first + k).cast("string") for k in range(corners)])).alias("text")
    )
    heads = [F.struct(F.lit(0).alias("line"), F.concat(F.lit("usemtl mat"), F.col(key)).alias("text")), F.struct(F.lit(1).alias("line"), F.concat(F.lit("o obj"), F.col(key)).alias("text"))]
    head = shapes.where("shape = 0 and corner = 0").select(key, F.explode(F.array(*heads)).alias("h")).select(key, "h.*")
    return head.unionByName(vertex).unionByName(face)


def mtl_objects(objects: DataFrame, key: str) -> DataFrame:
    """Three lines of an MTL file for each object: its material's name, colour and opacity, from ``r, g, b, a`` of 0 to 255."""
    part = lambda c: F.format_string("%.6f", F.col(c) / F.lit(255.0))
    lines = [F.concat(F.lit("newmtl mat"), F.col(key)), F.concat(F.lit("kd "), F.concat_ws(" ", *[part(c) for c in "rgb"])), F.concat(F.lit("d "), part("a"))]
    return objects.select(key, F.posexplode(F.array(*lines)).alias("line", "text"))


#: Columns of a glyph table and their widths.
GLYPH_FIELDS = (("x", 3), ("y", 3), ("width", 2), ("height", 2), ("xoffset", 2), ("yoffset", 2), ("xadvance", 2))


def font_table(glyphs: DataFrame, most: int = 256) -> DataFrame:
    """A table row for each id from 0 to ``most`` - 1; ids without a glyph are zeros."""
    ids = glyphs.sparkSession.range(most).select(F.col("id").cast("int").alias("id"))
    fields = [F.format_string(f"%{w}d", F.coalesce(F.col(c).cast("int"), F.lit(0))) for c, w in GLYPH_FIELDS]
    return ids.join(glyphs, "id", "left").select("id", F.concat(F.lit("\t{ "), F.concat_ws(", ", *fields), F.lit(" },")).alias("line"))


def write_setting(settings: DataFrame, updates: DataFrame) -> DataFrame:
    """``(section, key, value)`` after updates of the same columns; names fold ASCII letters' case, as settings files do."""
    names = [F.lower("section").alias("_s"), F.lower("key").alias("_k")]
    old, new = settings.select("*", *names), updates.select("*", *names)
    kept = old.join(new.select("_s", "_k"), ["_s", "_k"], "left_anti")
    return kept.select("section", "key", "value").unionByName(new.select("section", "key", "value"))


def settings_lines(settings: DataFrame) -> DataFrame:
    """Lines of a settings file: each section's head, then its keys in order."""
    heads = settings.select("section").distinct().select("section", F.lit("").alias("key"), F.concat(F.lit("["), "section", F.lit("]")).alias("line"))
    return heads.unionByName(settings.select("section", "key", F.concat("key", F.lit("="), "value").alias("line")))
