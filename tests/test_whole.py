"""Queries and operators against brute force over the whole of their input."""

import bisect
import collections
import math
import os
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from voxelspark.operators import codec, image, voxel
from voxelspark.plans import catalogue
from voxelspark.sources import adapters, files
from voxelspark.streaming import sequences

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the supplied tables")


def test_all_starts_enter_the_lookup(spark):
    got = {r["frame"]: (r["sequence_id"], r["frame_rank"]) for r in catalogue.QUERIES["frame_to_sequence"](spark, SF).collect()}
    events = spark.read.parquet(f"{SF}/events.parquet").selectExpr("event_id", "user_id", "cast(ts as date) as day").collect()
    first = {}
    for r in events:
        k = (r["user_id"], r["day"])
        first[k] = min(first.get(k, r["event_id"]), r["event_id"])
    starts = sorted(set(first.values()))
    at = {r["event_id"]: bisect.bisect_right(starts, r["event_id"]) for r in events}
    assert got == {f: (k or None, f - starts[k - 1] if k else None) for f, k in at.items()}


def test_every_sequence_is_validated_against_the_next(spark):
    got = collections.Counter(tuple(r[c] for c in ("sequence_id", "user_id", "event_type", "n", "side")) for r in catalogue.QUERIES["stream_validate"](spark, SF).collect())
    found = collections.defaultdict(collections.Counter)
    frames = adapters.frames(spark, SF).collect()
    for r in frames:
        found[r["frame"] // 7][(r["user_id"], r["event_type"], r["n"])] += 1
    want = collections.Counter()
    for s in range(min(found), max(found)):
        for side, rest in (("left", found[s] - found[s + 1]), ("right", found[s + 1] - found[s])):
            want.update({(s, *k, side): v for k, v in rest.items()})
    assert max(r["frame"] for r in frames) > 14 and got == want


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The folder of ``events.parquet`` as 20 part files, more than a batch takes, in order of time."""
    folder = tmp_path_factory.mktemp("parts")
    (folder / "events.parquet").mkdir()
    table = pq.read_table(f"{SF}/events.parquet").sort_by([("ts", "ascending"), ("event_id", "ascending")])
    step = -(-len(table) // 20)
    for k in range(20):
        path = folder / "events.parquet" / f"part-{k:05d}.parquet"
        pq.write_table(table.slice(k * step, step), path)
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    return str(folder)


def test_part_files_are_counted(spark, parts):
    got = {(r["start"].date(), r["event_type"]): r["n"] for r in catalogue.QUERIES["stream_sequence_counts"](spark, parts).collect()}
    rows = spark.read.parquet(f"{SF}/events.parquet").selectExpr("cast(ts as date) as day", "event_type").groupBy("day", "event_type").count().collect()
    assert got == {(r["day"], r["event_type"]): r["count"] for r in rows}


def test_part_files_out_of_order_are_counted(spark, parts):
    folder = f"{parts}/events.parquet"
    for k, name in enumerate(sorted((n for n in os.listdir(folder) if n.endswith(".parquet")), reverse=True)):
        os.utime(f"{folder}/{name}", (1_700_001_000 + k, 1_700_001_000 + k))
    got = sequences.run_to_end(sequences.sequence_counts(sequences.read_events(spark, folder, files_per_trigger=3)), "complete")
    assert got.groupBy().sum("n").first()[0] == spark.read.parquet(folder).count()
    for k, name in enumerate(sorted(n for n in os.listdir(folder) if n.endswith(".parquet"))):
        os.utime(f"{folder}/{name}", (1_700_000_000 + k, 1_700_000_000 + k))


def test_part_files_are_folded(spark, parts):
    got = {}
    for r in catalogue.QUERIES["stream_temporal_blend"](spark, parts).collect():
        got[r["user_id"]] = max(got.get(r["user_id"], (0, 0.0)), (r["seen"], r["value"]))
    want = {}
    for r in spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id").collect():
        n, v = want.get(r["user_id"], (0, 0.0))
        want[r["user_id"]] = (n + 1, r["value"] if n == 0 else v + (r["value"] - v) * 0.25)
    assert {k: (n, round(v, 5)) for k, (n, v) in got.items()} == {k: (n, round(v, 5)) for k, (n, v) in want.items()}


def ycocg(r, g, b):
    t = b + (r - b) * 0.5
    return t + (g - t) * 0.5, r - b, g - t


def resolved_by_hand(frames, width, height, blend):
    """Last image in YCoCg and alpha, pixel by pixel."""
    black = (0.0, 0.0, 0.0)
    past = None
    for frame in frames:
        now, out = {p: ycocg(*v[:3]) for p, v in frame.items()}, {}
        for (x, y), (_, _, _, dx, dy, a) in frame.items():
            if past is None:
                out[x, y] = (*now[x, y], float(a > 0))
                continue
            hx, hy = x - dx, y + dy
            i, j = math.floor(hx), math.floor(hy)
            taps = [((i + di, j + dj), (hx - i if di else 1 - hx + i) * (hy - j if dj else 1 - hy + j)) for di in (0, 1) for dj in (0, 1)]
            old = [sum(past.get(p, (*black, 0.0))[c] * w for p, w in taps) for c in range(4)]
            off = not (0 <= (hx + 0.5) / width <= 1 and 0 <= (hy + 0.5) / height <= 1)
            response = max(float(off or old[3] > 0), float(a > 0), blend)
            around = [now.get(p, black) for p in ((x, y), (x - 1, y), (x + 1, y), (x, y - 1), (x, y + 1))]
            share = min(math.hypot(dx, dy) / 2, 1)
            new = []
            for c in range(3):
                clamped = min(max(old[c], min(v[c] for v in around)), max(v[c] for v in around))
                prev = old[c] + (clamped - old[c]) * share
                new.append(prev + (now[x, y][c] - prev) * response)
            out[x, y] = (*new, float(a > 0))
        past = out
    return past


def test_images_are_resolved_with_motion_clamp_and_response(spark):
    rng, width, height = random.Random(5), 6, 5
    moves = (0.0, 0.0, 0.5, -1.25, 3.0)
    frames = [
        {(x, y): (*(rng.randrange(256) for _ in "rgb"), rng.choice(moves), rng.choice(moves), float(rng.random() < 0.15)) for x in range(width) for y in range(height)} for _ in range(3)
    ]
    rows = [(k, *p, *v) for k, frame in enumerate(frames) for p, v in frame.items()]
    df = spark.createDataFrame(rows, "frame int, x int, y int, r int, g int, b int, dx double, dy double, a double")
    got = {(r["x"], r["y"]): r for r in image.temporal_resolve(df, 0.25, width, height).collect()}
    want = resolved_by_hand(frames, width, height, 0.25)
    assert got.keys() == want.keys()
    for p, (*wide, a) in want.items():
        assert ycocg(*(got[p][c] for c in "rgb")) == pytest.approx(wide, abs=1e-5) and got[p]["a"] == a


def test_streamed_history_starts_again_at_cuts(spark, tmp_path):
    rows = [(k, f"2024-01-01 00:00:{k:02d}", 1, float(v), cut) for k, (v, cut) in enumerate([(8, False), (4, None), (20, True), (12, False)])]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, value double, cut boolean")
    df.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = sequences.run_to_end(sequences.blend_history(sequences.read_events(spark, str(tmp_path / "events.parquet")), 0.25), "update")
    assert [tuple(r) for r in got.collect()] == [(1, 4, 18.0)]


def test_blocks_keep_the_colours_of_their_cells(spark):
    leaves = {(r["x"], r["y"], r["z"]): (r["r"], r["g"], r["b"]) for r in voxel.leaf_colors(voxel.leaves(adapters.cells(spark, SF))).collect()}
    blocks = catalogue.QUERIES["block_colors"](spark, SF)
    got = {(r["x"], r["y"], r["z"]): (r["r"], r["g"], r["b"]) for r in codec.block_cells(blocks).collect()}
    within = collections.defaultdict(list)
    for p, c in leaves.items():
        within[tuple(v >> 2 for v in p)].append(c)
    want, error = {}, 0
    for p, c in leaves.items():
        low, high = ([f(v) for v in zip(*within[tuple(v >> 2 for v in p)])] for f in (min, max))
        palette = [low, high, [(2 * a + b) // 3 for a, b in zip(low, high)], [(a + 2 * b) // 3 for a, b in zip(low, high)]]
        want[p] = tuple(min(palette, key=lambda q: sum((a - b) ** 2 for a, b in zip(q, c))))
        error += sum((a - b) ** 2 for a, b in zip(want[p], c))
    assert got == want and blocks.groupBy().sum("error", "cells").first()[:] == (error, len(leaves))


def test_faces_keep_all_corners(spark, tmp_path):
    (tmp_path / "s.obj").write_text("f " + " ".join(str(k) for k in range(1, 101)) + "\n")
    found = collections.defaultdict(list)
    for r in files.read_obj(spark, str(tmp_path / "s.obj"))["corners"].orderBy("triangle", "corner").collect():
        found[r["triangle"]].append(r["position"])
    assert list(found.values()) == [[1, k, k + 1] for k in range(2, 100)]
