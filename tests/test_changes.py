"""Key frames and changes, tables along a curve, and ends along an axis, against plain loops."""

import os
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from voxelspark.functions import bits
from voxelspark.operators import changes, codec
from voxelspark.sources import layout

FRAMES = "frame int, block long, n int"


def sequence(seed=1, frames=17, blocks=12):
    r = random.Random(seed)
    now, rows = {}, []
    for f in range(frames):
        for b in range(blocks):
            what = r.random()
            if what < 0.2:
                now.pop(b, None)
            elif what < 0.5:
                now[b] = r.choice([None, 1, 2])
        rows += [(f, b, n) for b, n in now.items() if f != 9]  # one frame is empty
    return rows


def test_any_frame_is_rebuilt_from_one_partition(spark, tmp_path):
    rows = sequence()
    df = spark.createDataFrame(rows, FRAMES)
    log = changes.change_log(df, ["block"], ["n"], 5)
    path = str(tmp_path / "log")
    changes.write_log(log, path)
    for f in range(17):
        found = changes.seek(spark, path, f, ["block"], 5)
        assert sorted(tuple(r) for r in found.collect()) == sorted((r for r in rows if r[0] == f), key=lambda r: r[:2]), f
    plan = changes.seek(spark, path, 8, ["block"], 5)
    scan = next(x for x in plan._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x)
    assert "PartitionFilters: [isnotnull(sequence_id" in scan and "PushedFilters: [IsNotNull(frame), LessThanOrEqual(frame,8)]" in scan
    back = changes.rebuild(spark.read.parquet(path), ["block"], 5).select("frame", "block", "n").collect()
    assert sorted(map(tuple, back), key=repr) == sorted(rows, key=repr)
    kinds = {r["kind"] for r in log.collect()}
    assert kinds == {"key", "added", "removed", "recoloured"}
    assert all(r["frame"] % 5 == 0 for r in log.where("kind = 'key'").collect()) and log.where("kind = 'removed' and n is not null").isEmpty()


def test_what_stays_costs_nothing(spark):
    still = spark.range(30).select((F.col("id") % 10).cast("int").alias("frame"), F.lit(1).cast("long").alias("block"), F.lit(7).alias("n")).distinct()
    assert [(r["frame"], r["kind"]) for r in changes.change_log(still, ["block"], ["n"], 10).collect()] == [(0, "key")]
    assert changes.change_log(still.limit(0), ["block"], ["n"], 10).isEmpty()


@pytest.mark.parametrize("low, high", [((0, 0, 0), (31, 31, 31)), ((3, 5, 9), (3, 5, 9)), ((4, 0, 8), (19, 15, 30)), ((9, 9, 9), (8, 9, 9))])
@pytest.mark.parametrize("most", [1, 5, 48, 10_000])
def test_ranges_hold_the_whole_box(low, high, most):
    ranges = layout.key_ranges(low, high, 5, most)
    key = lambda p: sum((c >> k & 1) << 3 * k + a for k in range(5) for a, c in enumerate(p))
    inside = {key((x, y, z)) for x in range(low[0], high[0] + 1) for y in range(low[1], high[1] + 1) for z in range(low[2], high[2] + 1)}
    covered = {k for a, b in ranges for k in range(a, b + 1)}
    assert inside <= covered and len(ranges) <= most
    assert ranges == sorted(ranges) and all(a[1] + 1 < b[0] for a, b in zip(ranges, ranges[1:]))
    if most == 10_000 and inside:
        assert covered == inside


def test_boxes_prune_row_groups(spark, tmp_path):
    points = spark.range(60_000).select(*[(F.xxhash64("id", F.lit(s)) % 64 + 64).cast("int").alias(c) for s, c in enumerate("xyz")], "id").selectExpr("x % 64 as x", "y % 64 as y", "z % 64 as z", "id").repartition(6)
    path, low, high = str(tmp_path / "m"), (8, 16, 24), (19, 27, 35)
    layout.write_morton(points, path, 6, row_group=16 << 10)
    box = layout.read_box(spark, path, low, high, 6)
    plain = points.where(" and ".join(f"{c} between {a} and {b}" for c, a, b in zip("xyz", low, high)))
    assert sorted(r["id"] for r in box.collect()) == sorted(r["id"] for r in plain.collect()) and box.columns == points.columns
    ranges = layout.key_ranges(low, high, 6)
    read = total = 0
    for f in os.listdir(path):
        if f.endswith(".parquet"):
            meta = pq.ParquetFile(os.path.join(path, f)).metadata
            at = next(i for i in range(meta.num_columns) if meta.row_group(0).column(i).path_in_schema == "key")
            for g in range(meta.num_row_groups):
                stats = meta.row_group(g).column(at).statistics
                total += meta.row_group(g).total_byte_size
                read += meta.row_group(g).total_byte_size if any(a <= stats.max and stats.min <= b for a, b in ranges) else 0
    assert read < 0.35 * total  # bytes of row groups that the ranges leave
    rows = layout.read_box(spark, path, low, high, 6)
    rows.collect()
    leaves = rows._jdf.queryExecution().executedPlan().collectLeaves()
    assert leaves.apply(0).metrics().apply("numOutputRows").value() < 0.4 * 60_000  # and the scan leaves the others out
    assert "Or(" in rows._jdf.queryExecution().executedPlan().toString()


def test_keys_interleave(spark):
    r = random.Random(0)
    rows = [tuple(r.randrange(1 << 21) for _ in range(3)) for _ in range(50)]
    got = spark.createDataFrame(rows, "x int, y int, z int").select("x", "y", "z", bits.morton(F.col("x"), F.col("y"), F.col("z"), 21).alias("key")).collect()
    for p in got:
        assert p["key"] == sum((p[c] >> k & 1) << 3 * k + a for k in range(21) for a, c in enumerate("xyz"))


def test_the_axis_is_never_worse_than_the_box(spark):
    r = random.Random(6)
    pixels = []
    for x in range(48):
        for y in range(16):
            tile = (x // 4, y // 4)
            t = r.random()
            if tile[0] % 3 == 0:  # colours along a falling line, where the box's diagonal is wrong
                rgb = (int(255 * t), int(255 * (1 - t)), 40)
            elif tile[0] % 3 == 1:
                rgb = tuple(r.randrange(256) for _ in range(3))
            else:
                rgb = (9, 9, 9)
            pixels.append((x, y, *rgb))
    df = spark.createDataFrame(pixels, "x int, y int, r int, g int, b int")
    box, axis = ({(b["tx"], b["ty"]): b for b in codec.bc1_blocks(df, quality=q).collect()} for q in (0, 2))
    assert all(axis[k]["error"] <= box[k]["error"] for k in box)
    lines = [k for k in box if k[0] % 3 == 0]
    assert sum(axis[k]["error"] for k in lines) < 0.1 * sum(box[k]["error"] for k in lines)
    shown = {(p["x"], p["y"]): (p["r"], p["g"], p["b"]) for p in codec.bc1_pixels(codec.bc1_blocks(df, quality=2)).collect()}
    assert sum((a - b) ** 2 for x, y, *rgb in pixels for a, b in zip(rgb, shown[(x, y)], strict=True)) == sum(b["error"] for b in axis.values())
