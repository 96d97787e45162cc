"""Scans over runs of runs against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from voxelspark.operators import metrics, scan, sorting, text, timeline


def brute(rows, merge):
    out, last = {}, {}
    for by, order, value in sorted(rows, key=lambda r: (r[1])):
        out[(by, order)] = last.get(by)
        if value is not None:
            last[by] = value if by not in last else merge(last[by], value)
    return out


@pytest.mark.parametrize("run, levels", [(5, 4), (3, 5), (4096, 1)])
def test_levels_until_one_run_is_left(spark, run, levels):
    r = random.Random(run)
    rows = [(k % 3, o, r.choice([None, r.randint(-5, 9)])) for k, o in enumerate(r.sample(range(-40, 150), 120))]
    bounds = (min(x[1] for x in rows), max(x[1] for x in rows))
    assert scan.levels_of(0, 149, run) >= levels or run > 100
    df = spark.createDataFrame(rows, "by int, o long, v long").repartition(3)
    got = scan.scan(df, "o", {"s": (F.col("v"), scan.SUM), "m": (F.col("v"), scan.GREATEST), "l": (F.when(F.col("v").isNotNull(), F.struct("o", "v")), scan.LAST)}, by=("by",), run=run)
    assert got.columns == ["by", "o", "v", "s", "m", "l"]
    found = {(x["by"], x["o"]): x for x in got.collect()}
    assert {k: x["s"] for k, x in found.items()} == brute(rows, lambda a, b: a + b)
    assert {k: x["m"] for k, x in found.items()} == brute(rows, max)
    assert {k: x["l"] and x["l"]["v"] for k, x in found.items()} == brute(rows, lambda a, b: b)
    assert scan.scan(df, "o", {"s": (F.col("v"), scan.SUM)}, by=("by",), run=run, bounds=bounds).count() == 120


def test_no_window_holds_more_than_a_run(spark):
    df = spark.range(2000).select("id", F.lit(1).cast("long").alias("v"))
    plan = scan.scan(df, "id", {"s": (F.col("v"), scan.SUM)}, run=7)
    assert scan.levels_of(0, 1999, 7) == 4
    assert [r["s"] for r in plan.orderBy("id").collect()] == [None, *range(1, 2000)]
    text_ = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text_.count("Window [") == 4 and "windowspecdefinition(_o" not in text_  # all are partitioned by a run
    assert scan.scan(df.limit(0), "id", {"s": (F.col("v"), scan.SUM)}).isEmpty()


def test_users_of_scans(spark):
    df = spark.range(1000).select((F.col("id") * 13 % 1009).alias("o"), (F.col("id") % 5).alias("v"))
    rows = sorted((r["o"], r["v"]) for r in df.collect())
    total, want = 0, {}
    for o, v in rows:
        total += v
        want[o] = total
    assert {r["o"]: r["total"] for r in sorting.running_totals(df, "o", "v", 6).collect()} == want
    holes = df.withColumn("v", F.when(F.col("v") != 2, F.col("v")))
    assert [r["total"] for r in sorting.running_totals(holes, "o", "v", 6).orderBy("o").collect()] == [t - 2 * sum(v == 2 for _, v in rows[: k + 1]) for k, t in enumerate(want.values())]
    ids = sorting.dense_ids(df, "v", "o", 1000, run=6).collect()
    for v in range(5):
        assert [r["id"] for r in sorted((r for r in ids if r["v"] == v), key=lambda r: r["o"])] == list(range(200))
    starts = spark.createDataFrame([(o, k) for k, (o, _) in enumerate(rows[3::40])], "start long, sequence_id int")
    found = {r["frame"]: (r["sequence_id"], r["frame_rank"]) for r in timeline.sequence_lookup(df.select(F.col("o").alias("frame")), starts, run=4).collect()}
    firsts = [o for o, _ in rows[3::40]]
    for o, _ in rows:
        k = sum(f <= o for f in firsts) - 1
        assert found[o] == ((k, o - firsts[k]) if k >= 0 else (None, None))
    events = df.select(F.lit(1).alias("u"), "o", F.col("v").cast("int").alias("m"))
    changed = {r["o"]: r["changed"] for r in metrics.edges(events, "u", "o", "m", 5).collect()}
    before = 0
    for o, v in rows:
        assert changed[o] == v ^ before
        before = v


def test_box_triangles_close_and_face_outward():
    corners = [tuple(k >> a & 1 for a in range(3)) for k in range(8)]
    edges = [(t[i], t[(i + 1) % 3]) for t in text.BOX_TRIANGLES for i in range(3)]
    assert len(text.BOX_TRIANGLES) == 12 and len(set(edges)) == 36 and {(b, a) for a, b in edges} == set(edges)
    for t in text.BOX_TRIANGLES:
        a, b, c = (corners[k] for k in t)
        u, v = [y - x for x, y in zip(a, b)], [y - x for x, y in zip(a, c)]
        n = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
        assert sum(n[i] * (2 * a[i] - 1) for i in range(3)) > 0


def test_more_streams_than_a_merge_takes(spark):
    rows = spark.range(17).select(F.col("id").alias("stream"), F.lit(0).alias("sequence_id"))
    assert timeline.merge_streams(rows.where("stream < 16")).count() == 16
    with pytest.raises(Exception, match="more than 16 streams"):
        timeline.merge_streams(rows).collect()
