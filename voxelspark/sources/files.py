"""Files of the reference's kinds: fonts, scenes, settings, images, raw frames; and streams as partitioned tables."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.text import key_values
from . import images
from .images import RAW_MAGIC


def read_font(spark: SparkSession, path: str) -> DataFrame:
    """Glyphs of a bitmap-font description: a row for each line that starts with ``char`` and has an id below 256.

    An id of 256 or more fails the read, as it would not fit the table."""
    lines = spark.read.text(path).where(F.col("value").startswith("char "))
    m = lines.select(key_values(F.col("value")).alias("m"))
    names = ("id", "x", "y", "width", "height", "xoffset", "yoffset", "xadvance")
    glyphs = m.select(*[F.element_at("m", n).cast("int").alias(n) for n in names])
    checked = F.when(F.col("id") < 256, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("glyph id out of range: "), F.coalesce(F.col("id").cast("string"), F.lit("none")))).cast("int"))
    return glyphs.withColumn("id", checked)


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """``(path, section, key, value, line)`` of INI files; comments are skipped, the last value of a key of a file's section counts,
    with the number of its line from 0.  Keys before the first section of a file have an empty one."""
    lines = _lines(spark, path)
    head = F.when(F.col("line").rlike(r"^\s*\[[^\]]*\]"), F.regexp_extract("line", r"^\s*\[([^\]]*)\]", 1))
    lines = lines.withColumn("section", F.coalesce(F.last(head, ignorenulls=True).over(_in_order()), F.lit("")))
    pairs = lines.where(F.col("line").rlike(r"^\s*[^;#\[=\s][^=]*=")).select(
        "path", "at", "section", F.trim(F.substring_index("line", "=", 1)).alias("key"), F.trim(F.regexp_replace("line", r"^[^=]*=", "")).alias("value")
    )
    return pairs.groupBy("path", "section", "key").agg(F.max_by("value", "at").alias("value"), F.max("at").alias("line"))


def setting(settings: DataFrame, keys: DataFrame) -> DataFrame:
    """Values of ``keys(section, key, default)``, or their defaults; keys without a section have the last value of any.  Where
    several files set a key, the last file by path counts."""
    by = [c for c in ("section", "key") if c in keys.columns]
    last = settings.groupBy(*by).agg(F.max_by("value", F.struct("path", "line")).alias("value"))
    return keys.join(last, by, "left").select(*by, F.coalesce("value", "default").alias("value"))


def read_mtl(spark: SparkSession, path: str) -> DataFrame:
    """``(path, material, property, values)`` of MTL files: numbers as they are written, file names as one value."""
    words = _lines(spark, path).where(F.col("line").rlike(r"^\s*[^#\s]")).select("path", "at", F.split(F.trim("line"), r"\s+").alias("w"))
    name = F.when(F.lower(F.col("w")[0]) == "newmtl", F.get("w", F.lit(1)))
    rows = words.withColumn("material", F.last(name, ignorenulls=True).over(_in_order())).where(F.lower(F.col("w")[0]) != "newmtl")
    rest = F.slice("w", 2, F.size("w"))
    values = F.when(F.lower(F.col("w")[0]).startswith("map_"), F.array(F.concat_ws(" ", rest))).otherwise(rest)
    return rows.select("path", "material", F.lower(F.col("w")[0]).alias("property"), values.alias("values"))


#: Capacities of a scene's paths.
PATHS_MOST, POSITIONS_MOST = 2, 128


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    """``(path_id, entity, speed, positions)`` of a JSON file of lines with ``entity``, ``speed`` and ``positions`` (arrays of
    three numbers); more than 2 paths, or more than 128 positions in one, fail the read."""
    rows = spark.read.schema("entity string, speed double, positions array<array<double>>").json(path)
    counted = rows.agg(F.sort_array(F.collect_list(F.struct("entity", "speed", "positions"))).alias("p"))  # one file of a few lines
    fits = (F.size("p") <= PATHS_MOST) & F.forall("p", lambda x: F.size(x["positions"]) <= POSITIONS_MOST)
    checked = F.when(fits, F.col("p")).otherwise(F.raise_error(F.lit("more paths or positions than a scene holds")).cast(counted.schema["p"].dataType))
    return counted.select(F.posexplode(checked).alias("path_id", "q")).select("path_id", "q.*")


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """``(path, size, content)`` of each file; a path without files fails."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), "content")


def read_obj(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``positions``, ``normals``, ``uvs`` (id from 1 and coordinates) and ``corners`` (triangle, corner, ids) of OBJ files; ids and
    triangles count from 1 in each file, whose ``path`` all four tables have."""
    words = _lines(spark, path).select("path", "at", F.split(F.trim("line"), r"\s+").alias("w"))

    def numbered(kind: str, names: str) -> DataFrame:
        rows = words.where(F.col("w")[0] == kind).select("path", F.row_number().over(_in_order()).alias("id"), *[F.get("w", F.lit(i + 1)).cast("double").alias(c) for i, c in enumerate(names)])
        return rows

    made = [F.sum(F.when(F.col("w")[0] == kind, 1).otherwise(0)).over(_in_order().rowsBetween(Window.unboundedPreceding, 0)).cast("int").alias(f"n{i}") for i, kind in enumerate(("v", "vt", "vn"))]
    faces = words.select("path", "at", "w", *made).where(F.col("w")[0] == "f").select("path", "at", F.slice("w", 2, F.size("w")).alias("c"), "n0", "n1", "n2")
    fan = faces.select("path", "at", "n0", "n1", "n2", F.explode(F.expr("transform(sequence(1, size(c) - 2), i -> array(c[0], c[i], c[i + 1]))")).alias("t"))
    corners = fan.select("path", F.row_number().over(_in_order()).alias("triangle"), "t", "n0", "n1", "n2").select("path", "triangle", F.posexplode("t").alias("corner", "ids"), "n0", "n1", "n2")

    def absolute(i: int) -> Column:  # ids below 0 count back from the last one read
        k = F.get(F.split("ids", "/"), F.lit(i))
        k = F.when(k != "", k).cast("int")
        return F.when(k < 0, F.col(f"n{i}") + k + 1).otherwise(k)

    ids = [absolute(i).alias(n) for i, n in enumerate(("position", "uv", "normal"))]
    return {"positions": numbered("v", "xyz"), "normals": numbered("vn", "xyz"), "uvs": numbered("vt", "uv"), "corners": corners.select("path", "triangle", "corner", *ids)}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``(path, at, line)`` of text files, lines numbered from 0 in each."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("at", "line"))


def _in_order():
    """Each file's lines in order: the ids of an OBJ file are places in it, and a file is read whole by one task anyway."""
    return Window.partitionBy("path").orderBy("at")


def read_tga(spark: SparkSession, path: str) -> DataFrame:
    """``(path, x, y, r, g, b, a)`` of TGA images of all kinds, rows from the top; a folder or a file."""
    return images.read_images(spark, path, "tga", "path string, x int, y int, r int, g int, b int, a int")


def bmp_images(pixels: DataFrame, key: str) -> DataFrame:
    """``(key, content)``: a 24-bit BMP file of each image ``(key, x, y, r, g, b)``; missing pixels are black."""

    def encode(name: tuple, p: pd.DataFrame) -> pd.DataFrame:
        width, height = int(p["x"].max()) + 1, int(p["y"].max()) + 1
        row = (width * 3 + 3) // 4 * 4
        body = np.zeros((height, row), dtype=np.uint8)
        for i, c in enumerate("bgr"):
            body[height - 1 - p["y"], p["x"] * 3 + i] = p[c]
        head = struct.pack("<2sIHHI", b"BM", 54 + body.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, body.size, 2835, 2835, 0, 0)
        return pd.DataFrame({"key": [name[0]], "content": [head + body.tobytes()]})

    kind = dict(pixels.dtypes)[key]
    return pixels.groupBy(key).applyInPandas(encode, f"key {kind}, content binary").withColumnRenamed("key", key)


def raw_frames(pixels: DataFrame, key: str) -> DataFrame:
    """``(key, content)``: each frame ``(key, x, y, r, g, b, a, depth)`` as one blob: magic, width and height (32-bit), colours
    (4 bytes a pixel), depths (32-bit floats); missing pixels are 0."""

    def encode(name: tuple, p: pd.DataFrame) -> pd.DataFrame:
        width, height = int(p["x"].max()) + 1, int(p["y"].max()) + 1
        colors, depths = np.zeros((height, width, 4), dtype=np.uint8), np.zeros((height, width), dtype="<f4")
        for i, c in enumerate("rgba"):
            colors[p["y"], p["x"], i] = p[c]
        depths[p["y"], p["x"]] = p["depth"]
        return pd.DataFrame({"key": [name[0]], "content": [RAW_MAGIC + struct.pack("<II", width, height) + colors.tobytes() + depths.tobytes()]})

    kind = dict(pixels.dtypes)[key]
    return pixels.groupBy(key).applyInPandas(encode, f"key {kind}, content binary").withColumnRenamed("key", key)


def raw_frame_pixels(blobs: DataFrame, key: str) -> DataFrame:
    """Pixels of blobs as ``raw_frames`` writes them; another magic fails the read."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch[key], batch["content"], strict=True):
                if data[:4] != RAW_MAGIC:
                    raise ValueError(f"{name}: not a raw frame")
                width, height = struct.unpack("<II", data[4:12])
                n = width * height
                y, x = np.divmod(np.arange(n, dtype=np.int32), max(width, 1))
                colors = np.frombuffer(data, dtype=np.uint8, offset=12, count=4 * n).reshape(n, 4).astype(np.int32)
                depths = np.frombuffer(data, dtype="<f4", offset=12 + 4 * n, count=n)
                yield pd.DataFrame({key: name, "x": x, "y": y, **{c: colors[:, i] for i, c in enumerate("rgba")}, "depth": depths})

    return blobs.select(key, "content").mapInPandas(decode, f"{key} {dict(blobs.dtypes)[key]}, x int, y int, r int, g int, b int, a int, depth float")


def tile_images(tiles: DataFrame, tile: int) -> DataFrame:
    """One image from tiles ``(tx, ty, x, y, r, g, b, depth)`` of ``tile`` x ``tile`` pixels, with each depth also as 0 to 255
    between the least and the greatest of all; where all are equal that is 0.  The range is one row, joined to all."""
    span = tiles.agg(F.min("depth").alias("_low"), F.max("depth").alias("_high"))
    share = F.coalesce(F.try_divide(F.col("depth") - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0))
    return tiles.crossJoin(F.broadcast(span)).select(
        (F.col("tx") * tile + F.col("x")).alias("x"), (F.col("ty") * tile + F.col("y")).alias("y"), "r", "g", "b", "depth", (share * 255 + 0.5).cast("int").alias("shade")
    )


def read_frames(spark: SparkSession, template: str, offset: int, count: int) -> DataFrame:
    """Parquet frames of a printf-style path, with their number as ``frame``."""
    paths = [template % k for k in range(offset, offset + count)]
    number = F.regexp_extract(F.input_file_name(), r"(\d+)[^\d/]*(?:/[^/]*)?$", 1).cast("int")
    return spark.read.parquet(*paths).withColumn("frame", number)


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Paths, sizes and times of the files below a folder whose names match."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).drop("content")


def with_existence(rows: DataFrame, column: str, listed: DataFrame) -> DataFrame:
    """Rows with ``exists``: whether a path is among those of ``list_files``, with or without its scheme."""
    plain = lambda c: F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)", "")
    there = listed.select(plain(F.col("path")).alias("__path")).distinct().withColumn("__there", F.lit(True))
    found = rows.join(there, plain(F.col(column)) == F.col("__path"), "left")
    return found.withColumn("exists", F.coalesce("__there", F.lit(False))).drop("__path", "__there")


def write_stream(stream: DataFrame, path: str, extend: bool = False, codec: str = "zstd") -> None:
    """A stream as a table partitioned by sequence, in compressed columns (``zstd``, or ``lz4`` for speed); ``extend`` appends.

    A sequence's rows go to few files: the adaptive plan splits a sequence that is large and joins small ones."""
    stream.hint("rebalance", "sequence_id").write.mode("append" if extend else "error").option("compression", codec).partitionBy("sequence_id").parquet(path)


def extend_stream(stream: DataFrame, path: str, first: int | None = None, codec: str = "zstd") -> None:
    """Append a stream whose sequences are numbered from 0; its first becomes ``first``, or the next after those of the table.

    Writers at the same time must give ids of their own: the table keeps no lock."""
    if first is None:
        last = stream.sparkSession.read.parquet(path).agg(F.max("sequence_id")).first()[0]
        first = 0 if last is None else last + 1
    write_stream(stream.withColumn("sequence_id", (F.col("sequence_id") + first).cast("int")), path, extend=True, codec=codec)


def stream_schema(spark: SparkSession, path: str) -> tuple[list[str], list[int]]:
    """A stream's columns and sequences, from footers and folder names alone; no data is read."""
    table = spark.read.parquet(path)
    return table.columns, sorted(r[0] for r in table.select("sequence_id").distinct().collect())


def read_sequence(spark: SparkSession, path: str, sequence_id: int) -> DataFrame:
    """One sequence: only its partition is read."""
    return spark.read.parquet(path).where(F.col("sequence_id") == sequence_id)
