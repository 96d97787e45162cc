"""Readers and writers on small files, streams with concurrent writers, callbacks and cancelling."""

import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelspark.operators import sorting, text
from voxelspark.sources import files
from voxelspark.streaming import sequences


def test_settings_keep_sections_apart(spark, tmp_path):
    path = tmp_path / "s.ini"
    path.write_text("first=0\n[a]\nx = 1\n; note\nx=2\ny=k=v\n[b]\nx=3\n")
    got = {(r["section"], r["key"]): r["value"] for r in files.read_settings(spark, str(path)).collect()}
    assert got == {("", "first"): "0", ("a", "x"): "2", ("a", "y"): "k=v", ("b", "x"): "3"}
    keys = spark.createDataFrame([("a", "x", "9"), ("b", "y", "7")], "section string, key string, default string")
    assert {(r["section"], r["value"]) for r in files.setting(files.read_settings(spark, str(path)), keys).collect()} == {("a", "2"), ("b", "7")}
    updates = spark.createDataFrame([("A", "X", "5"), ("c", "z", "1")], "section string, key string, value string")
    lines = text.settings_lines(text.write_setting(files.read_settings(spark, str(path)), updates)).orderBy("section", "key")
    assert [r["line"] for r in lines.collect()] == ["[]", "first=0", "[A]", "X=5", "[a]", "y=k=v", "[b]", "x=3", "[c]", "z=1"]


def test_materials_and_relative_faces(spark, tmp_path):
    (tmp_path / "m.mtl").write_text("# m\nnewmtl red\nKd 1 0 0\nmap_Kd my file.tga\nnewmtl blue\nKd 0 0 1\nillum 2\n")
    got = {(r["material"], r["property"]): r["values"] for r in files.read_mtl(spark, str(tmp_path / "m.mtl")).collect()}
    assert got == {("red", "kd"): ["1", "0", "0"], ("red", "map_kd"): ["my file.tga"], ("blue", "kd"): ["0", "0", "1"], ("blue", "illum"): ["2"]}
    (tmp_path / "s.obj").write_text("v 0 0 0\nv 1 0 0\nv 0 1 0\nvt 0 1\nvn 0 0 1\nf -3/-1/-1 -2//1 3\nv 5 5 5\nf 1 2 -1\n")
    rows = files.read_obj(spark, str(tmp_path / "s.obj"))["corners"].orderBy("triangle", "corner").collect()
    assert [(r["position"], r["uv"], r["normal"]) for r in rows] == [(1, 1, 1), (2, None, 1), (3, None, None), (1, None, None), (2, None, None), (4, None, None)]


def tga(width, height, pixels, depth, top, runs):
    head = struct.pack("<BBBHHBHHHHBB", 3, 0, 10 if runs else 2, 0, 0, 0, 0, 0, width, height, depth, 0x20 if top else 0) + b"abc"
    rows = [pixels[y * width : (y + 1) * width] for y in range(height)]
    flat = [p for row in (rows if top else rows[::-1]) for p in row]
    raw = [bytes([b, g, r, *([a] if depth == 32 else [])]) for r, g, b, a in flat]
    if not runs:
        return head + b"".join(raw)
    out, i = b"", 0
    while i < len(raw):
        n = 1
        while i + n < len(raw) and n < 128 and raw[i + n] == raw[i]:
            n += 1
        out += (bytes([127 + n]) if n > 1 else bytes([0])) + raw[i]
        i += n
    return head + out


@pytest.mark.parametrize("depth", [24, 32])
@pytest.mark.parametrize("top", [False, True])
@pytest.mark.parametrize("runs", [False, True])
def test_tga_pixels(spark, tmp_path, depth, top, runs):
    rng = np.random.default_rng(3)
    pixels = [tuple(int(v) for v in p) for p in rng.integers(0, 2, (15, 4)) * 200]
    (tmp_path / "i.tga").write_bytes(tga(5, 3, pixels, depth, top, runs))
    rows = files.read_tga(spark, str(tmp_path / "i.tga")).orderBy("y", "x").collect()
    assert [(r["x"], r["y"]) for r in rows] == [(x, y) for y in range(3) for x in range(5)]
    assert [(r["r"], r["g"], r["b"], r["a"]) for r in rows] == [(*p[:3], p[3] if depth == 32 else 255) for p in pixels]


def test_raw_frames_and_bitmaps(spark, tmp_path):
    rows = [(f, x, y, (x * 7 + f) % 256, y, 3, 255, x / 4 + y) for f in (1, 2) for x in range(5) for y in range(3)]
    frames = spark.createDataFrame(rows, "frame int, x int, y int, r int, g int, b int, a int, depth float")
    back = files.raw_frame_pixels(files.raw_frames(frames, "frame"), "frame")
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in frames.collect())
    bad = spark.createDataFrame([(1, bytearray(b"V6F1" + bytes(8)))], "frame int, content binary")
    with pytest.raises(Exception, match="not a raw frame"):
        files.raw_frame_pixels(bad, "frame").collect()
    image = files.bmp_images(frames, "frame").where("frame = 2").first()["content"]
    size, offset, width, height = (struct.unpack_from("<I", image, k)[0] for k in (2, 10, 18, 22))
    assert (image[:2], size, width, height) == (b"BM", len(image), 5, 3)
    assert tuple(image[offset + 16 * 2 + 3 : offset + 16 * 2 + 6]) == (3, 0, 9)  # top row, second pixel: blue, green, red


def test_paths_have_capacities(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"entity": "a", "speed": 1.5, "positions": [[0, 0, 0], [1, 2, 3]]}\n{"entity": "b", "speed": 2, "positions": []}\n')
    rows = files.read_paths(spark, str(tmp_path / "p.json")).collect()
    assert [(r["path_id"], r["entity"], len(r["positions"])) for r in rows] == [(0, "a", 2), (1, "b", 0)]
    (tmp_path / "q.json").write_text('{"entity": "a", "positions": [' + ", ".join(["[0, 0, 0]"] * 129) + "]}\n")
    with pytest.raises(Exception, match="more paths or positions"):
        files.read_paths(spark, str(tmp_path / "q.json")).collect()


def test_raw_frames_by_template_and_listing(spark, tmp_path):
    for k in range(3):
        spark.range(k + 1).write.parquet(str(tmp_path / f"frame_{k:03d}.parquet"))
    got = files.read_frames(spark, str(tmp_path / "frame_%03d.parquet"), 1, 2).groupBy("frame").count().collect()
    assert {(r["frame"], r["count"]) for r in got} == {(1, 2), (2, 3)}
    (tmp_path / "a.txt").write_text("abc")
    assert [r["length"] for r in files.list_files(spark, str(tmp_path), "*.txt").collect()] == [3]
    assert [(r["size"], bytes(r["content"])) for r in files.read_whole(spark, str(tmp_path / "a.txt")).collect()] == [(3, b"abc")]
    with pytest.raises(Exception):
        files.read_whole(spark, str(tmp_path / "none.txt")).collect()


@pytest.mark.parametrize("codec", ["zstd", "lz4"])
def test_streams_extend_with_new_ids(spark, tmp_path, codec):
    path = str(tmp_path / "stream")
    rows = spark.range(20).select((F.col("id") % 4).cast("int").alias("sequence_id"), F.col("id").alias("block"))
    files.write_stream(rows, path, codec=codec)
    files.extend_stream(rows, path, codec=codec)
    files.extend_stream(rows, path, first=11, codec=codec)  # another writer has the ids between
    columns, found = files.stream_schema(spark, path)
    assert set(columns) == {"sequence_id", "block"} and found == [*range(8), *range(11, 15)]
    assert files.read_sequence(spark, path, 11).count() == 5
    assert any(codec in p.name for p in (tmp_path / "stream").rglob("*.parquet"))


def test_capacity_and_dense_ids(spark):
    rows = spark.range(5000).select("id", (F.col("id") % 3).alias("kind"), (F.col("id") * 7).alias("at"))
    got = sorting.dense_ids(rows, "kind", "at", 1700, "n", run=100).collect()
    for kind in range(3):
        assert [r["n"] for r in sorted((r for r in got if r["kind"] == kind), key=lambda r: r["at"])] == list(range(1667 if kind < 2 else 1666))
    with pytest.raises(Exception, match="more than 1666 of 0"):
        sorting.dense_ids(rows, "kind", "at", 1666, "n").collect()
    assert sorting.at_most(rows, 5000, "rows").count() == 5000
    with pytest.raises(Exception, match="more than 4999 rows: 5000"):
        sorting.at_most(rows, 4999, "rows").collect()
    assert [r["id"] for r in sorting.ascending(rows, F.col("id") % 2, F.col("kind"), ties="id").limit(3).collect()] == [0, 6, 12]


def test_events_reach_their_callback(spark, tmp_path):
    spark.createDataFrame([(1, 4), (2, 1), (3, 5)], "frame_id long, events int").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("frame_id long, events int").parquet(str(tmp_path / "e"))
    seen = []
    query = sequences.on_events(stream, 4, lambda rows, k: seen.extend(r["frame_id"] for r in rows.collect()), str(tmp_path / "c"))
    query.awaitTermination()
    assert sorted(seen) == [1, 3] and sequences.availability(query) is sequences.Availability.SUCCEEDED


def test_a_failed_stream_is_failed(spark, tmp_path):
    spark.createDataFrame([(1, 4)], "frame_id long, events int").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("frame_id long, events int").parquet(str(tmp_path / "e"))
    query = sequences.on_events(stream, 4, lambda rows, k: 1 / 0, str(tmp_path / "c"))
    with pytest.raises(Exception):
        query.awaitTermination()
    assert sequences.availability(query) is sequences.Availability.FAILED


def test_work_is_waited_for_and_cancelled(spark):
    done = []
    good = sequences.Encoding(spark, lambda: done.append(spark.range(10).count()))
    assert good.wait(60) and done == [10]
    slow = F.udf(lambda x: (time.sleep(30), x)[1], "long")
    bad = sequences.Encoding(spark, lambda: spark.range(4, numPartitions=4).select(slow("id")).collect())
    assert not bad.wait(3)
    bad.cancel()
    with pytest.raises(Exception):
        bad.wait(25)


def test_two_files_are_read_apart(spark, tmp_path):
    for name, at, key in (("a", 0.0, "one"), ("b", 9.0, "two")):
        (tmp_path / f"{name}.ini").write_text(f"top = {name}\n[{key}]\nx = {name}\n\n[{key}]\nx = last {name}\n")
        (tmp_path / f"{name}.obj").write_text(f"v {at} 0 0\nv {at} 1 0\nvt 0.{int(at)} 1\nv {at} 0 1\nf 1/1 2/1 3/1\nf -3 -2 -1\n")
        (tmp_path / f"{name}.mtl").write_text(f"newmtl {key}\nKd {at} 0 0\n")
    settings = files.read_settings(spark, str(tmp_path / "*.ini")).collect()
    assert {(r["path"][-5:], r["section"], r["key"], r["value"]) for r in settings} == {
        ("a.ini", "", "top", "a"), ("b.ini", "", "top", "b"), ("a.ini", "one", "x", "last a"), ("b.ini", "two", "x", "last b")
    }
    keys = spark.createDataFrame([("top", "none"), ("gone", "none")], "key string, default string")
    assert {tuple(r) for r in files.setting(files.read_settings(spark, str(tmp_path / "*.ini")), keys).collect()} == {("top", "b"), ("gone", "none")}
    scene = files.read_obj(spark, str(tmp_path / "*.obj"))
    assert sorted((r["path"][-5:], r["id"], r["x"]) for r in scene["positions"].collect()) == [(f"{n}.obj", k, x) for n, x in (("a", 0.0), ("b", 9.0)) for k in (1, 2, 3)]
    corners = sorted((r["path"][-5:], r["triangle"], r["corner"], r["position"]) for r in scene["corners"].collect())
    assert corners == [(f"{n}.obj", t, c, c + 1) for n in "ab" for t in (1, 2) for c in range(3)]
    assert {(r["path"][-5:], r["material"], r["values"][0]) for r in files.read_mtl(spark, str(tmp_path / "*.mtl")).collect()} == {("a.mtl", "one", "0.0"), ("b.mtl", "two", "9.0")}


def test_paths_that_exist(spark, tmp_path):
    (tmp_path / "a b.txt").write_text("x")
    asked = spark.createDataFrame([(str(tmp_path / "a b.txt"),), (f"file://{tmp_path}/a b.txt",), (str(tmp_path / "none"),), (None,)], "p string")
    got = files.with_existence(asked, "p", files.list_files(spark, str(tmp_path)).withColumn("path", F.regexp_replace("path", "%20", " ")))
    assert sorted((r["p"] or "", r["exists"]) for r in got.collect()) == sorted([("", False), (str(tmp_path / "a b.txt"), True), (f"file://{tmp_path}/a b.txt", True), (str(tmp_path / "none"), False)])
