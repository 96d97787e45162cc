"""Image files as data sources: round trips, every kind of TGA, and what filters and schemas leave out."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelspark.sources import images


def picture(w=7, h=5, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 4)).astype(np.uint8)


def runs(pixels):
    """Pixels (n, step) as packets: repeats of two and more, others one by one."""
    out, at = b"", 0
    while at < len(pixels):
        n = 1
        while at + n < len(pixels) and n < 128 and (pixels[at + n] == pixels[at]).all():
            n += 1
        out += bytes([127 + n] if n > 1 else [0]) + pixels[at].tobytes()
        at += n
    return out


def head(kind, w, h, bits, flags, entries=0, first=0, entry_bits=0, note=b""):
    return struct.pack("<BBBHHBHHHHBB", len(note), int(entries > 0), kind, first, entries, entry_bits, 0, 0, w, h, bits, flags) + note


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("flags", [0x28, 0x08, 0x38, 0x18])
def test_every_kind_of_tga_from_every_corner(packed, flags):
    rgba = picture()
    rgba[1] = rgba[1, 0]  # a run
    h, w = rgba.shape[:2]
    turned = rgba if flags & 0x20 else rgba[::-1]
    turned = turned[:, ::-1] if flags & 0x10 else turned
    flat = turned.reshape(-1, 4)
    body = lambda p: runs(p) if packed else p.tobytes()
    kind = 8 * packed
    true32 = head(2 + kind, w, h, 32, flags, note=b"note") + body(flat[:, [2, 1, 0, 3]])
    assert (images.tga_image("t", true32).rgba == rgba).all()
    true24 = images.tga_image("t", head(2 + kind, w, h, 24, flags) + body(np.ascontiguousarray(flat[:, [2, 1, 0]]))).rgba
    assert (true24[:, :, :3] == rgba[:, :, :3]).all() and (true24[:, :, 3] == 255).all()
    five = flat.astype(np.int64) >> 3
    v = five[:, 0] << 10 | five[:, 1] << 5 | five[:, 2] | (flat[:, 3] >> 7).astype(np.int64) << 15
    low = np.stack([v & 255, v >> 8], axis=1).astype(np.uint8)
    got = images.tga_image("t", head(2 + kind, w, h, 16, flags & 0x30 | 1) + body(low)).rgba
    assert (got[:, :, :3] >> 3 == rgba[:, :, :3] >> 3).all() and (got[:, :, 3] == np.where(rgba[:, :, 3] >> 7, 255, 0)).all()
    grey = images.tga_image("t", head(3 + kind, w, h, 8, flags) + body(flat[:, :1].copy())).rgba
    assert all((grey[:, :, c] == rgba[:, :, 0]).all() for c in range(3)) and (grey[:, :, 3] == 255).all()
    palette = picture(16, 1, 9)[0]
    index = (flat[:, :1] & 15) + 3
    mapped = images.tga_image("t", head(1 + kind, w, h, 8, flags, 16, 3, 24) + np.ascontiguousarray(palette[:, [2, 1, 0]]).tobytes() + body(index.astype(np.uint8))).rgba
    assert (mapped[:, :, :3] == palette[rgba[:, :, 0] & 15][:, :, :3]).all()


@pytest.mark.parametrize("data", [b"", head(2, 4, 4, 32, 0) + b"abc", head(10, 4, 4, 32, 0) + b"\xff", head(7, 1, 1, 8, 0) + b"a", head(2, 1, 1, 12, 0) + b"ab", head(1, 1, 1, 8, 0, 1, 0, 24) + b"abc\x05"])
def test_what_is_no_tga_fails(data):
    with pytest.raises(ValueError):
        images.tga_image("t", data)


@pytest.mark.parametrize("kind", ["rawframe", "tga", "bmp"])
def test_round_trip_of_frames(spark, tmp_path, kind):
    rows = [(f, x, y, f, x * 20, y * 30, 255 if kind == "bmp" else x, float(x + y) / 4) for f in (3, 12, 40) for x in range(6) for y in range(5)]
    df = spark.createDataFrame(rows, "frame int, x int, y int, r int, g int, b int, a int, depth float")
    path = str(tmp_path / "out")
    images.write_images(df.repartition(4), path, kind)
    got = images.read_images(spark, path, kind)
    assert got.select("frame").distinct().count() == 3
    want = rows if kind == "rawframe" else [(*r[:7], None) for r in rows]
    assert sorted(map(tuple, got.select("frame", "x", "y", "r", "g", "b", "a", "depth").collect())) == sorted(want)
    some = images.read_images(spark, path, kind, "x int, r int")
    assert some.columns == ["x", "r"] and some.count() == 90
    images.write_images(df, path, kind)  # again: the same files
    assert images.read_images(spark, path, kind).count() == 90


def test_filters_leave_files_out(spark, tmp_path):
    path = str(tmp_path / "out")
    images.write_images(spark.range(40).select(F.col("id").cast("int").alias("frame"), F.lit(0).alias("x"), F.lit(0).alias("y"), *[F.lit(9).alias(c) for c in "rgb"]), path, "tga")
    (tmp_path / "out" / "frame-00000007.tga").write_bytes(b"broken")  # only who reads it finds out
    rows = images.read_images(spark, path, "tga")
    assert [r["frame"] for r in rows.where("frame = 8").collect()] == [8]
    assert rows.where("frame in (3, 5, 50) and r = 9").count() == 2 and rows.where("frame = 8").rdd.getNumPartitions() == 1
    with pytest.raises(Exception, match="cut short"):
        rows.where("frame > 5").count()


def test_tiles_have_places(spark, tmp_path):
    tiles = spark.range(4 * 9).selectExpr("cast(id div 9 % 2 as int) tx", "cast(id div 18 as int) ty", "cast(id % 3 as int) x", "cast(id % 9 div 3 as int) y", "cast(id as int) r", "1 g", "2 b", "cast(id as float) depth")
    images.write_images(tiles, str(tmp_path / "t"), "rawframe")
    got = images.read_images(spark, str(tmp_path / "t"), "rawframe")
    assert sorted(map(tuple, got.select(tiles.columns).collect())) == sorted(map(tuple, tiles.collect()))
    assert got.where("tx = 1 and ty = 0").count() == 9
    assert images.numbers_of("a/b12/frame-007.tga") == (7, None, None) and images.numbers_of("x/tile_3_04.frm") == (None, 3, 4) and images.numbers_of("logo.tga") == (None, None, None)
