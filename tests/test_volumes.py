"""Linked octrees, culling by a frontier, and rays down to cells, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from voxelspark.functions.geometry import Camera
from voxelspark.operators import codec, grid, octree, trace, voxel

CAMERA = Camera.looking((0.0, 0.0, 0.0), 0.1, -0.05, 1.2, 0.9)


@pytest.mark.parametrize("levels, run", [(3, 5), (6, 4096), (0, 4)])
def test_links_lead_to_the_leaf_of_the_shifted_key(spark, levels, run):
    r = random.Random(levels)
    most = (1 << levels) - 1
    cells = list({tuple(r.randint(0, most) for _ in range(3)) for _ in range(90)})
    df = spark.createDataFrame(cells + cells[:5], "x int, y int, z int")
    nodes = octree.linked_nodes(df, levels, run)
    rows = {n["node_id"]: n for n in nodes.collect()}
    assert sorted(rows) == list(range(len(rows)))
    want = {(k, *(c >> (levels - k) for c in cell)) for cell in cells for k in range(levels + 1)}
    assert {(n["level"], n["x"], n["y"], n["z"]) for n in rows.values()} == want
    for n in rows.values():
        octants = [k for k in range(8) if n["child_mask"] >> k & 1]
        assert bool(octants) == (n["level"] < levels) == (n["first_child"] is not None)
        for i, k in enumerate(octants):
            child = rows[n["first_child"] + i]
            assert (child["level"], child["x"], child["y"], child["z"]) == (n["level"] + 1, 2 * n["x"] + (k & 1), 2 * n["y"] + (k >> 1 & 1), 2 * n["z"] + (k >> 2))
    asked = spark.createDataFrame([*cells, *[(most - x, y, z) for x, y, z in cells]], "x int, y int, z int")
    leaf = {(n["x"], n["y"], n["z"]): i for i, n in rows.items() if n["level"] == levels}
    for s in octree.descend(asked, nodes, levels).collect():
        assert s["leaf"] == leaf.get((s["x"], s["y"], s["z"]))


def test_no_cells_no_nodes(spark):
    none = spark.createDataFrame([], "x int, y int, z int")
    assert octree.linked_nodes(none, 3).isEmpty()
    assert [s["leaf"] for s in octree.descend(spark.createDataFrame([(1, 2, 3)], "x int, y int, z int"), octree.linked_nodes(none, 3), 3).collect()] == [None]


def test_the_frontier_keeps_what_a_flat_test_keeps_and_tests_less(spark):
    levels, origin, size = 5, (-4.0, -4.0, -6.0), 0.25
    r = random.Random(2)
    cells = list({tuple(r.randint(0, 31) for _ in range(3)) for _ in range(1500)})
    nodes = octree.linked_nodes(spark.createDataFrame(cells, "x int, y int, z int"), levels)
    tested = octree.frontier_cull(nodes, CAMERA, levels, origin, size).collect()
    flat = nodes.where(F.col("level") == levels).withColumns(octree.node_box(levels, origin, size)).where(trace.in_frustum(CAMERA)).collect()
    assert {n["node_id"] for n in tested if n["level"] == levels and n["kept"]} == {n["node_id"] for n in flat}
    assert 0 < len(flat) < len(cells) and sum(n["level"] == levels for n in tested) < len(cells)
    assert len({n["node_id"] for n in tested}) == len(tested)


def brute_hit(ray, cells):
    o, d = ray[:3], ray[3:]
    best = None
    for c, rgb in cells.items():
        t0, t1 = 0.0, 1e300
        for i in range(3):
            if d[i] == 0:
                t0, t1 = (t0, t1) if c[i] <= o[i] < c[i] + 1 else (1.0, 0.0)
            else:
                a, b = sorted(((c[i] - o[i]) / d[i], (c[i] + 1 - o[i]) / d[i]))
                t0, t1 = max(t0, a), min(t1, b)
        if t1 - t0 > 1e-6 and (best is None or (round(t0, 6), c) < best[:2]):
            best = (round(t0, 6), c, rgb)
    return best


def test_rays_stop_at_the_nearest_cell(spark):
    r = random.Random(8)
    cells = {tuple(r.randint(0, 15) for _ in range(3)): tuple(r.choice([(10, 20, 30), (200, 90, 7)])) for _ in range(160)}
    rows = [(*c, *rgb) for c, rgb in cells.items()]
    blocks = codec.block_colors(spark.createDataFrame(rows, "x int, y int, z int, r int, g int, b int"))
    shown = {(c["x"], c["y"], c["z"]): (c["r"], c["g"], c["b"]) for c in codec.block_cells(blocks).collect()}
    rays = []
    for k in range(300):
        target = r.choice(list(cells))
        origin = [r.uniform(-5, 21) for _ in range(3)]
        way = [t + r.uniform(0.05, 0.95) - o for t, o in zip(target, origin, strict=True)]
        rays.append((k, *origin, *way))
    rays += [(300, -3.0, 5.5, 7.5, 1.0, 0.0, 0.0), (301, 5.5, 40.0, 3.5, 0.0, -2.0, 0.0), (302, -3.0, 50.0, 0.5, 1.0, 0.0, 0.0), (303, 0.5, 0.5, 0.5, -1.0, -1.0, -1.0), (304, 8.0, 8.0, -1.0, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rays, "ray_id int, ox double, oy double, oz double, dx double, dy double, dz double")
    got = {h["ray_id"]: (h["t"], (h["x"], h["y"], h["z"]), (h["r"], h["g"], h["b"])) for h in grid.cell_hits(df, blocks, 4).collect()}
    for k, *ray in rays:
        assert got.get(k) == brute_hit(ray, shown), k
    assert len(got) >= 290


def test_masks_decide_and_not_boxes(spark):
    one = voxel.leaf_colors(voxel.leaves(spark.createDataFrame([(3, 3, 3, 9, 9, 9)], "x int, y int, z int, r int, g int, b int")))
    rays = spark.createDataFrame([(1, -1.0, 0.5, 0.5, 1.0, 0.0, 0.0), (2, -1.0, 3.5, 3.5, 1.0, 0.0, 0.0)], "ray_id int, ox double, oy double, oz double, dx double, dy double, dz double")
    assert [(h["ray_id"], h["t"]) for h in grid.cell_hits(rays, codec.block_colors(one), 2).collect()] == [(2, 4.0)]


def test_more_views_than_a_capture_holds(spark):
    from voxelspark.operators import capture

    views = capture.cube_views(capture.sample_offsets(spark, 32, 0.05))
    pixels = spark.range(4).selectExpr("cast(id as int) view_id", "0 x", "0 y", "0.5D depth", "1 r", "2 g", "3 b")
    assert capture.cube_face_samples(pixels, views, 4, 0.08, 0.1, False).count() == 4
    with pytest.raises(Exception, match="more than 192 views"):
        capture.cube_face_samples(pixels, views.union(views), 4, 0.08, 0.1, False).count()
