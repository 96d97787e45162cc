"""Invariants: sums of leaves, masks, delta ranges and back, merge and trim; files written and read again."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from voxelspark.operators import capture, fit, metrics, sorting, text, timeline, voxel
from voxelspark.sources import adapters, files

SF = "/root/testdata/sf0.001"


def test_leaves_keep_all_samples(spark):
    cells = adapters.cells(spark, SF)
    leaves = voxel.leaves(cells)
    assert leaves.agg(F.sum("cnt")).first()[0] == cells.count()
    blocks = voxel.block_masks(leaves)
    assert blocks.agg(F.sum("cells"), F.sum("points")).first() == (leaves.count(), cells.count())


def test_ranks_of_unique_keys(spark):
    keys = random.Random(1).sample(range(1 << 19), 1000)
    got = sorting.bitmap_ranks(spark.createDataFrame([(k,) for k in keys + keys[:50]], "key long"), "key").collect()
    assert {r["key"]: r["rank"] for r in got} == {k: i for i, k in enumerate(sorted(keys))}


def test_ranges_rebuild_frames(spark):
    frames = adapters.frames(spark, SF)
    again = timeline.reconstruct(timeline.delta_ranges(frames, ["user_id", "event_type"], ["n"], 7)).select(frames.columns)
    assert timeline.difference(frames, again).isEmpty()


def test_merge_then_trim(spark):
    rows = [(s, q, f"{s}{q}") for s in (0, 1) for q in range(3)]
    merged = timeline.merge_streams(spark.createDataFrame(rows, "stream int, sequence_id int, v string"))
    assert sorted((r["sequence_id"], r["v"]) for r in merged.collect()) == list(enumerate(["00", "01", "02", "10", "11", "12"]))
    assert sorted((r["sequence_id"], r["v"]) for r in timeline.trim_stream(merged, 1, 2).collect()) == [(0, "01"), (1, "02"), (2, "10")]


def test_lookup_before_the_first_start_is_null(spark):
    got = timeline.sequence_lookup(spark.createDataFrame([(1,), (5,), (5000,)], "frame long"), spark.createDataFrame([(3, 0), (2000, 1)], "start long, sequence_id int"))
    assert {tuple(r) for r in got.collect()} == {(1, None, None), (5, 0, 2), (5000, 1, 3000)}


def test_empty_box_is_inverted(spark):
    got = fit.bounding_box(spark.createDataFrame([], "x double, y double, z double")).first()
    assert got["min_x"] == fit.FLT_MAX and got["max_x"] == -fit.FLT_MAX


def test_coincident_points_have_no_line(spark):
    got = fit.line_2d(spark.createDataFrame([(1, 2.0, 3.0)] * 4, "g int, x double, y double"), "g").first()
    assert (got["cx"], got["cy"], got["dx"]) == (2.0, 3.0, None)


def test_streams_extend_and_prune(spark, tmp_path):
    path = str(tmp_path / "stream")
    one = spark.createDataFrame([(0, "a"), (1, "b")], "sequence_id int, v string")
    files.write_stream(one, path)
    files.extend_stream(one, path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("sequence_id", "v").collect()) == [(0, "a"), (1, "b"), (2, "a"), (3, "b")]
    plan = files.read_sequence(spark, path, 2)
    assert [r["v"] for r in plan.collect()] == ["a"]
    assert "PartitionFilters: [isnotnull(sequence_id" in plan._jdf.queryExecution().toString()


def test_fonts_settings_and_images(spark, tmp_path):
    (tmp_path / "f.fnt").write_text("info face=x\nchar id=65   x=1 y=2 width=3 height=4 xoffset=0 yoffset=-1 xadvance=9\n")
    assert tuple(files.read_font(spark, str(tmp_path / "f.fnt")).first()) == (65, 1, 2, 3, 4, 0, -1, 9)
    (tmp_path / "bad.fnt").write_text("char id=256 x=1\n")
    with pytest.raises(Exception, match="glyph id out of range"):
        files.read_font(spark, str(tmp_path / "bad.fnt")).collect()
    (tmp_path / "s.ini").write_text("[a]\nx = 1\n; c = 2\nx=3\n")
    keys = spark.createDataFrame([("x", "0"), ("y", "7")], "key string, default string")
    assert {tuple(r) for r in files.setting(files.read_settings(spark, str(tmp_path / "s.ini")), keys).collect()} == {("x", "3"), ("y", "7")}
    header = struct.pack("<BBBHHBHHHHBB", 0, 0, 2, 0, 0, 0, 0, 0, 2, 1, 24, 0)
    (tmp_path / "i.tga").write_bytes(header + bytes([3, 2, 1, 6, 5, 4]))
    assert [tuple(r)[1:] for r in files.read_tga(spark, str(tmp_path / "i.tga")).orderBy("x").collect()] == [(0, 0, 1, 2, 3, 255), (1, 0, 4, 5, 6, 255)]


def test_scene_files(spark, tmp_path):
    (tmp_path / "s.obj").write_text("v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nvt 0 0\nf 1/1 2/1 3/1 4/1\n")
    scene = files.read_obj(spark, str(tmp_path / "s.obj"))
    assert scene["positions"].count() == 4
    assert sorted(tuple(r) for r in scene["corners"].select("triangle", "corner", "position", "uv", "normal").collect()) == [
        (1, 0, 1, 1, None), (1, 1, 2, 1, None), (1, 2, 3, 1, None), (2, 0, 1, 1, None), (2, 1, 3, 1, None), (2, 2, 4, 1, None)
    ]


def test_hex_rows_hold_the_bytes(spark):
    data = bytes(range(20))
    got = text.hex_rows(spark.createDataFrame([(1, data)], "k int, b binary"), "k", "b").orderBy("row").collect()
    assert bytes(int(x, 16) for r in got for x in r["line"].split(", ")) == data and len(got) == 2


def test_windows_of_one_key_go_by_runs(spark):
    random_rows = random.Random(4)
    ids = random_rows.sample(range(400), 150)
    data = [(random_rows.choice([1, 1, 1, 2, None]), i, random_rows.randrange(1000), random_rows.randrange(16)) for i in ids]
    frames = spark.createDataFrame(data, "user_id int, frame_id long, draw_us long, events int")
    rings = {r["frame_id"]: (r["low"], r["mid"], r["high"]) for r in metrics.ring_markers(frames, "user_id", 7, 32).collect()}
    edges = {r["frame_id"]: (r["changed"], r["pressed"], r["released"]) for r in metrics.edges(frames, "user_id", "frame_id", "events", 32).collect()}
    want_rings, want_edges = {}, {}
    for key in (1, 2, None):
        rows = sorted((r for r in data if r[0] == key), key=lambda r: r[1])
        for k, (_, i, _, mask) in enumerate(rows):
            last = [r[2] for r in rows[max(k - 6, 0) : k + 1]]
            want_rings[i] = (min(last), round(sum(last) / len(last), 4), max(last))
            changed = mask ^ (rows[k - 1][3] if k else 0)
            want_edges[i] = (changed, changed & mask, changed & ~mask)
    assert edges == want_edges
    assert rings.keys() == want_rings.keys() and all(rings[i] == pytest.approx(want_rings[i], abs=1e-3) for i in rings)
    assert metrics.ring_markers(frames.limit(0), "user_id").isEmpty() and metrics.edges(frames.limit(0), "user_id", "frame_id", "events").isEmpty()


def test_faces_of_a_cube_look_along_right_times_up(spark):
    for forward, right, up in capture.FACES:
        assert sum(a * b for a, b in zip(forward, right, strict=True)) == sum(a * b for a, b in zip(forward, up, strict=True)) == 0
        assert all(right[(k + 1) % 3] * up[(k + 2) % 3] - right[(k + 2) % 3] * up[(k + 1) % 3] == forward[k] for k in range(3))
    views = capture.cube_views(capture.sample_offsets(spark, 17, 0.05))
    assert sorted(r["view_id"] for r in views.collect()) == list(range(102))
    with pytest.raises(ValueError):
        capture.sample_offsets(spark, 33, 0.05)


def test_texels_beyond_the_image_and_without_a_place(spark):
    texels = spark.createDataFrame([(0, 0, 1, 2, 3), (1, 1, 4, 5, 6)], "x int, y int, r int, g int, b int")
    points = spark.createDataFrame([(1, -5.0, 0.2), (2, 9.0, 1.0), (3, 0.9, 0.1), (4, None, 0.5)], "id int, u double, v double")
    got = {r["id"]: (r["r"], r["g"], r["b"]) for r in capture.textured(points, texels, "u", "v", 2, 2).collect()}
    assert got == {1: (1, 2, 3), 2: (4, 5, 6), 3: (0, 0, 0), 4: (0, 0, 0)}
