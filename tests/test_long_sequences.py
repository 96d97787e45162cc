"""Images over long sequences: plans that do not grow, work that goes on, jitter and its reset."""

import random

from pyspark.sql import functions as F

from voxelspark.operators import image

SCHEMA = "frame int, x int, y int, r double, g double, b double, dx double, dy double, a double"


def images(spark, frames, size=4, still=1, seed=3):
    """``frames`` frames, each image shown ``still`` times."""
    r = random.Random(seed)
    rows = []
    for k in range(0, frames, still):
        shown = [(x, y, *(float(r.randrange(256)) for _ in "rgb"), r.choice([0.0, 0.5, -1.0]), r.choice([0.0, -0.5, 2.5]), float(r.random() < 0.1)) for x in range(size) for y in range(size)]
        rows += [(k + s, *p) for s in range(min(still, frames - k)) for p in shown]
    return rows, spark.createDataFrame(rows, SCHEMA)


def ycocg(rgb):
    co = rgb[0] - rgb[2]
    t = rgb[2] + co / 2
    return (t + (rgb[1] - t) / 2, co, rgb[1] - t)


def tap(image_, x, y, i):
    fx, fy = x // 1, y // 1
    return sum(image_.get((int(fx) + p, int(fy) + q), (0.0,) * 4)[i] * ((x - fx) if p else 1 - (x - fx)) * ((y - fy) if q else 1 - (y - fy)) for p in (0, 1) for q in (0, 1))


def brute(rows, blend, size, jitters=None):
    frames = sorted({r[0] for r in rows})
    history = None
    for n, k in enumerate(frames):
        now = {(r[1], r[2]): (*ycocg(r[3:6]), r[8]) for r in rows if r[0] == k}
        move = {(r[1], r[2]): r[6:8] for r in rows if r[0] == k}
        jx, jy = (jitters or {}).get(k, (0.5, 0.5))
        out = {}
        for (x, y), own in now.items():
            if n == 0:
                out[(x, y)] = (*own[:3], float(own[3] > 0))
                continue
            px, py = min(max(x + 0.5 - jx, 0), size - 1), min(max(y + jy - 0.5, 0), size - 1)
            own = [tap(now, px, py, i) for i in range(4)]
            dx, dy = move[(x, y)]
            hx, hy = x - dx, y + dy
            past = [tap(history, hx, hy, i) for i in range(4)]
            off = not (-0.5 <= hx <= size - 0.5 and -0.5 <= hy <= size - 0.5)
            w = 1.0 if off or past[3] > 0 or own[3] > 0 else blend
            share = min((dx * dx + dy * dy) ** 0.5 / 2, 1)
            new = []
            for i in range(3):
                around = [own[i]] + [now.get((x + p, y + q), (0.0,) * 4)[i] for p, q in ((-1, 0), (1, 0), (0, -1), (0, 1))]
                h = past[i] + (max(min(past[i], max(around)), min(around)) - past[i]) * share
                new.append(h + (own[i] - h) * w)
            out[(x, y)] = (*new, float(own[3] > 0))
        history = out
    back = {}
    for p, (lum, co, cg, a) in history.items():
        t = lum - cg / 2
        b = t - co / 2
        back[p] = (co + b, cg + t, b, a)
    return back


def close(got, want):
    assert set(got) == set(want)
    assert all(abs(a - b) < 1e-5 for p in want for a, b in zip(got[p], want[p], strict=True))


def shown(df):
    return {(p["x"], p["y"]): (p["r"], p["g"], p["b"], p["a"]) for p in df.collect()}


def test_long_sequences_in_plans_of_constant_size(spark, tmp_path):
    small = {"spark.sql.shuffle.partitions": "1", "spark.sql.adaptive.enabled": "false", "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
    keep = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():  # twenty frames of sixteen pixels: nothing is worth compiling
        spark.conf.set(k, v)
    try:
        rows, df = images(spark, 20)
        size = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("\n")
        folder = str(tmp_path / "resolve")
        short = image.temporal_resolve(df.where("frame < 5"), 0.25, 4, 4, every=4)
        some = image.temporal_resolve(df.where("frame < 10"), 0.25, 4, 4, every=4, folder=folder)
        close(shown(some), brute([r for r in rows if r[0] < 10], 0.25, 4))
        assert image._last_image(spark, folder) == 7
        whole = image.temporal_resolve(df, 0.25, 4, 4, every=4, folder=folder)  # goes on from frame 7
        assert image._last_image(spark, folder) == 19
        assert size(whole) <= size(short)
        close(shown(whole), brute(rows, 0.25, 4))
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_jitter_moves_the_sample_until_the_image_changes(spark):
    rows, df = images(spark, 5, size=4, still=3)
    counts = {r["frame"]: r["unchanged"] for r in image.unchanged_counts(df).collect()}
    assert counts == {k: k % 3 for k in range(5)}
    places = {r["frame"]: (r["jx"], r["jy"]) for r in image.jitter_offsets(image.unchanged_counts(df)).collect()}
    want = {0: (0.5, 0.5), 1: (0.5, 1 / 3), 2: (0.25, 2 / 3)}
    assert all(abs(a - b) < 1e-6 for k, p in places.items() for a, b in zip(p, want[k % 3], strict=True))
    close(shown(image.temporal_resolve(df, 0.25, 4, 4, jitter=True)), brute(rows, 0.25, 4, {k: want[k % 3] for k in range(5)}))


def test_an_empty_sequence_and_one_frame(spark):
    rows, df = images(spark, 1)
    close(shown(image.temporal_resolve(df, 0.25, 4, 4, jitter=True)), brute(rows, 0.25, 4))
    assert image.temporal_resolve(df.limit(0), 0.25, 4, 4).isEmpty()
    assert image.unchanged_counts(df.where(F.lit(False))).isEmpty()
