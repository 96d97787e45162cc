"""Registered queries over whole volumes and sequences: linked octrees, cells on rays, layouts, key frames, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import changes, codec, grid, image, octree, trace, voxel
from ..sources import adapters, files, folders, images, layout
from ..streaming import sequences, tiles
from .catalogue import _BOUNDS, _RAYS, _SLAB, _TILES, _TO_VIEW, CAMERA, CELLS, FRAMES, IMAGE, KEY, ORACLES, RATE, _binned, _rays, _resolve_sql, query

LEVELS = 6  # of the 64 x 64 x 64 grid


def morton_sql(x: str, y: str, z: str, levels: int) -> str:
    return "(" + " | ".join(f"((({v})::BIGINT >> {k} & 1) << {3 * k + a})" for k in range(levels) for a, v in enumerate((x, y, z))) + ")"


# --- linked octree -----------------------------------------------------------------------------------------------------

_NODES = f"""lf AS (SELECT DISTINCT x, y, z FROM cells), nd AS (SELECT DISTINCT lv AS level, x >> ({{levels}} - lv) AS x, y >> ({{levels}} - lv) AS y, z >> ({{levels}} - lv) AS z FROM {{leaf}}, (SELECT CAST(unnest(range({{levels}} + 1)) AS INT) AS lv)),
  ids AS (SELECT *, row_number() OVER (ORDER BY level, {morton_sql('x', 'y', 'z', LEVELS)}) - 1 AS node_id FROM nd),
  kids AS (SELECT level - 1 AS level, x >> 1 AS x, y >> 1 AS y, z >> 1 AS z, min(node_id) AS first_child, sum(1::BIGINT << ((x & 1) | ((y & 1) << 1) | ((z & 1) << 2)))::BIGINT AS child_mask FROM ids WHERE level > 0 GROUP BY ALL),
  linked AS (SELECT node_id, ids.level, ids.x, ids.y, ids.z, first_child, coalesce(child_mask, 0)::BIGINT AS child_mask FROM ids LEFT JOIN kids ON ids.level = kids.level AND ids.x = kids.x AND ids.y = kids.y AND ids.z = kids.z)"""


def _tree(levels: int, leaf: str) -> str:
    return _NODES.format(levels=levels, leaf=leaf)


@query(f"WITH {CELLS}, {_tree(LEVELS, 'lf')} SELECT * FROM linked")
def octree_nodes(spark: SparkSession, d: str) -> DataFrame:
    return octree.linked_nodes(adapters.cells(spark, d), LEVELS)


@query(f"WITH {CELLS}, {_tree(LEVELS, 'lf')} SELECT k, n, node_id AS leaf FROM cells JOIN ids ON level = {LEVELS} AND cells.x = ids.x AND cells.y = ids.y AND cells.z = ids.z")
def octree_descent(spark: SparkSession, d: str) -> DataFrame:
    """Each sample finds its leaf along the links from the root."""
    cells = adapters.cells(spark, d)
    nodes = octree.stored(octree.linked_nodes(cells, LEVELS), folders.shared_folder(spark, "octree") + "/nodes")
    return octree.descend(cells.select("k", "n", "x", "y", "z"), nodes, LEVELS).select("k", "n", "leaf")


# --- hierarchical cull -------------------------------------------------------------------------------------------------

BLOCK_LEVELS, BLOCK_ORIGIN, BLOCK_SIZE = 4, (-2.0, -2.0, -1.75), 0.25


def _corner_sql(level: str) -> str:
    """Box corners of nodes, and the test of every corner against the four sides."""
    edge = f"{BLOCK_SIZE!r}::DOUBLE * (1 << ({BLOCK_LEVELS} - {level}))"
    corner = lambda c, o, k: f"({o!r}::DOUBLE + ({c} + {k}) * {edge} - ({dict(zip('xyz', CAMERA.origin, strict=True))[c]!r}))"
    dot = lambda axis, k: "(" + " + ".join(f"{corner(c, o, k >> i & 1)} * ({a!r})" for i, (c, o, a) in enumerate(zip("xyz", BLOCK_ORIGIN, axis, strict=True))) + ")"
    sides = [
        "(" + " OR ".join(f"{s}{dot(axis, k)} <= {dot(CAMERA.forward, k)} * {tan!r}" for k in range(8)) + ")"
        for axis, tan in ((CAMERA.right, CAMERA.tan_x), (CAMERA.up, CAMERA.tan_y))
        for s in ("", "-")
    ]
    return " AND ".join(sides)


_CULLED = f"""lb AS (SELECT DISTINCT x >> 2 AS x, y >> 2 AS y, z >> 2 AS z FROM cells), {_tree(BLOCK_LEVELS, 'lb')}, seen AS (SELECT *, {_corner_sql('level')} AS kept FROM ids),
  tested AS (SELECT a.level, a.x, a.y, a.z, a.kept FROM seen a LEFT JOIN seen b ON b.level = a.level - 1 AND b.x = a.x >> 1 AND b.y = a.y >> 1 AND b.z = a.z >> 1 WHERE a.level = 0 OR b.kept)"""


def _culled(spark: SparkSession, d: str) -> DataFrame:
    blocks = adapters.cells(spark, d).select(*[F.shiftright(c, 2).alias(c) for c in "xyz"])
    nodes = octree.stored(octree.linked_nodes(blocks, BLOCK_LEVELS), folders.shared_folder(spark, "octree") + "/nodes")
    return octree.frontier_cull(nodes, CAMERA, BLOCK_LEVELS, BLOCK_ORIGIN, BLOCK_SIZE)


@query(f"WITH {CELLS}, {_CULLED} SELECT level, count(*) AS tested, count(*) FILTER (WHERE NOT kept) AS rejected, count(*) FILTER (WHERE kept) AS kept FROM tested GROUP BY level")
def hierarchical_cull(spark: SparkSession, d: str) -> DataFrame:
    return octree.cull_by_level(_culled(spark, d))


@query(f"WITH {CELLS}, {_CULLED} SELECT x, y, z FROM seen WHERE level = {BLOCK_LEVELS} AND kept")
def hierarchical_cull_blocks(spark: SparkSession, d: str) -> DataFrame:
    """What the frontier keeps; the twin tests every block."""
    return _culled(spark, d).where((F.col("level") == BLOCK_LEVELS) & F.col("kept")).select("x", "y", "z")


# --- cells on rays -----------------------------------------------------------------------------------------------------

GRID = 16  # blocks along an axis
_WAY = {"x": "1.0::DOUBLE", "y": "(c_custkey % 17 - 8) / 40.0::DOUBLE + 0.013::DOUBLE", "z": "(c_custkey % 11 - 5) / 90.0::DOUBLE + 0.007::DOUBLE"}
_FROM = {"x": "-6.3::DOUBLE", "y": "c_custkey * 7 % 53 + 0.37::DOUBLE", "z": "c_custkey * 3 % 11 + 0.41::DOUBLE"}
_CUSTOMER_RAYS = "ray AS (SELECT c_custkey AS ray_id, " + ", ".join([f"{v} AS o{c}" for c, v in _FROM.items()] + [f"{v} AS d{c}" for c, v in _WAY.items()]) + " FROM customer)"


def _customer_rays(spark: SparkSession, d: str) -> DataFrame:
    """A ray into the grid for each customer."""
    k = F.col("c_custkey")
    origin = {"ox": F.lit(-6.3), "oy": k * 7 % 53 + 0.37, "oz": k * 3 % 11 + 0.41}
    way = {"dx": F.lit(1.0), "dy": (k % 17 - 8) / 40.0 + 0.013, "dz": (k % 11 - 5) / 90.0 + 0.007}
    return adapters.table(spark, d, "customer").select(k.alias("ray_id"), *[v.alias(n) for n, v in (origin | way).items()])


def _cell_hit_sql() -> str:
    ctes = ORACLES["block_colors"].split(" SELECT bx,", 1)[0]
    index = "list_position([e0, e1, e2, e3], least(e0, e1, e2, e3)) - 1"
    shown = ", ".join(f"CAST(CASE {index} WHEN 0 THEN {c}0 WHEN 1 THEN {c}1 WHEN 2 THEN (2 * {c}0 + {c}1) // 3 ELSE ({c}0 + 2 * {c}1) // 3 END AS INT) AS {c}" for c in "rgb")
    low = ", ".join(f"least(({c} - o{c}) / nullif(d{c}, 0), ({c} + 1 - o{c}) / nullif(d{c}, 0))" for c in "xyz")
    high = low.replace("least", "greatest")
    return f"""{ctes}, {_CUSTOMER_RAYS}, shown AS (SELECT x, y, z, {shown} FROM lq),
  hit AS (SELECT ray_id, x, y, z, r, g, b, greatest({low}, 0.0) AS t0, least({high}) AS t1 FROM ray, shown),
  near AS (SELECT *, row_number() OVER (PARTITION BY ray_id ORDER BY round(t0, 6), x, y, z) AS k FROM hit WHERE t1 - t0 > 1e-6)
  SELECT ray_id, round(t0, 6) AS t, x, y, z, r, g, b FROM near WHERE k = 1"""


@query(_cell_hit_sql())
def ray_cell_hit(spark: SparkSession, d: str) -> DataFrame:
    """The twin tests every ray against every present cell."""
    blocks = codec.block_colors(voxel.leaf_colors(voxel.leaves(adapters.cells(spark, d))))
    return grid.cell_hits(_customer_rays(spark, d), blocks, GRID)


# --- key frames and changes --------------------------------------------------------------------------------------------

_SAME = " AND ".join(f"a.{c} = b.{c}" for c in KEY)
_LOG = f"""{FRAMES}, sq AS (SELECT CAST(frame // {RATE} AS INT) AS sequence_id, * FROM fr),
  lg AS (SELECT a.sequence_id, a.frame, CASE WHEN a.frame % {RATE} = 0 THEN 'key' WHEN b.frame IS NULL THEN 'added' ELSE 'recoloured' END AS kind, a.user_id, a.event_type, a.n
    FROM sq a LEFT JOIN sq b ON b.sequence_id = a.sequence_id AND b.frame = a.frame - 1 AND {_SAME} WHERE a.frame % {RATE} = 0 OR b.frame IS NULL OR a.n <> b.n
  UNION ALL SELECT b.sequence_id, CAST(b.frame + 1 AS INT), 'removed', b.user_id, b.event_type, NULL FROM sq b LEFT JOIN sq a ON a.frame = b.frame + 1 AND {_SAME} WHERE a.frame IS NULL AND (b.frame + 1) % {RATE} <> 0)"""


@query(f"WITH {_LOG} SELECT * FROM lg")
def change_log(spark: SparkSession, d: str) -> DataFrame:
    return changes.change_log(adapters.frames(spark, d), KEY, ["n"], RATE)


@query(f"WITH {FRAMES} SELECT CAST(frame // {RATE} AS INT) AS sequence_id, user_id, event_type, n, frame FROM fr")
def rebuilt_frames(spark: SparkSession, d: str) -> DataFrame:
    """All frames from a log that was written, partitioned by sequence, and read again; the twin has the frames themselves."""
    path = folders.shared_folder(spark, "log") + "/table"
    changes.write_log(changes.change_log(adapters.frames(spark, d), KEY, ["n"], RATE), path)
    return changes.rebuild(spark.read.parquet(path), KEY, RATE)


# --- layout along a curve ----------------------------------------------------------------------------------------------

BOX = ((8, 5, 2), (23, 20, 6))


@query(f"WITH {CELLS} SELECT k, n, x, y, z FROM cells WHERE " + " AND ".join(f"{c} BETWEEN {a} AND {b}" for c, a, b in zip("xyz", *BOX, strict=True)))
def morton_box(spark: SparkSession, d: str) -> DataFrame:
    """Samples of a box, from a table laid out along the Morton order; the twin filters all of them."""
    path = folders.shared_folder(spark, "morton") + "/table"
    layout.write_morton(adapters.cells(spark, d).select("k", "n", "x", "y", "z"), path, LEVELS)
    return layout.read_box(spark, path, *BOX, LEVELS)


# --- ends along the principal axis -------------------------------------------------------------------------------------


def _principal_sql() -> str:
    parts = lambda a, b: [f"{a}{{c}}", f"{b}{{c}}", f"(2 * {a}{{c}} + {b}{{c}}) // 3", f"({a}{{c}} + 2 * {b}{{c}}) // 3"]
    distance = lambda p: "(" + " + ".join(f"({c} - ({p.format(c=c)})) * ({c} - ({p.format(c=c)}))" for c in "rgb") + ")::BIGINT"
    errors = ", ".join(f"{distance(p)} AS {n}{k}" for n, a, b in (("e", "l", "h"), ("f", "p", "q")) for k, p in enumerate(parts(a, b)))
    moments = ", ".join(f"(count(*) * sum({a}::BIGINT * {b}) - sum({a}) * sum({b}))::DOUBLE AS v{a}{b}" for a, b in ("rr", "rg", "rb", "gg", "gb", "bb"))
    steps = ["a0 AS (SELECT *, 1::DOUBLE AS x_, 1::DOUBLE AS y_, 1::DOUBLE AS z_ FROM mo)"]
    for k in range(8):
        steps.append(f"w{k} AS (SELECT * EXCLUDE (x_, y_, z_), x_, y_, z_, vrr * x_ + vrg * y_ + vrb * z_ AS wx, vrg * x_ + vgg * y_ + vgb * z_ AS wy, vrb * x_ + vgb * y_ + vbb * z_ AS wz FROM a{k})")
        big = "greatest(abs(wx), abs(wy), abs(wz))"
        steps.append(f"a{k + 1} AS (SELECT * EXCLUDE (x_, y_, z_, wx, wy, wz), {', '.join(f'CASE WHEN {big} = 0 THEN {c}_ ELSE w{c} / {big} END AS {c}_' for c in 'xyz')} FROM w{k})")
    index = lambda n: f"list_position([{n}0, {n}1, {n}2, {n}3], least({n}0, {n}1, {n}2, {n}3)) - 1"
    least = lambda n: f"least({n}0, {n}1, {n}2, {n}3)"
    word = lambda n: f"bit_or(({index(n)})::BIGINT << (2 * (x % 4 + 4 * (y % 4))))"
    end = lambda n: f"any_value(({n}r::BIGINT << 16) | ({n}g::BIGINT << 8) | {n}b)"
    pick = lambda box, axis: f"CASE WHEN err_f < err_e THEN {axis} ELSE {box} END"
    return f"""WITH {CELLS}, {IMAGE}, t AS (SELECT *, x // 4 AS tx, y // 4 AS ty FROM img), mo AS (SELECT tx, ty, {moments}, {', '.join(f'min({c}) AS l{c}, max({c}) AS h{c}' for c in 'rgb')} FROM t GROUP BY tx, ty), {', '.join(steps)},
  pl AS (SELECT t.*, {', '.join(f'l{c}, h{c}' for c in 'rgb')}, r * x_ + g * y_ + b * z_ AS place FROM t JOIN a8 USING (tx, ty)),
  en AS (SELECT *, {', '.join(f'first_value({c}) OVER (PARTITION BY tx, ty ORDER BY place, r, g, b) AS p{c}, first_value({c}) OVER (PARTITION BY tx, ty ORDER BY place DESC, r DESC, g DESC, b DESC) AS q{c}' for c in 'rgb')} FROM pl),
  er AS (SELECT *, {errors} FROM en), bl AS (SELECT tx, ty, sum({least('e')})::BIGINT AS err_e, sum({least('f')})::BIGINT AS err_f, {word('e')} AS word_e, {word('f')} AS word_f, {', '.join(f'{end(n)} AS end_{n}' for n in 'lhpq')}, count(*) AS pixels FROM er GROUP BY tx, ty)
  SELECT CAST(tx AS INT) AS tx, CAST(ty AS INT) AS ty, {pick('end_l', 'end_p')} AS end0, {pick('end_h', 'end_q')} AS end1, {pick('word_e', 'word_f')} AS indexes, least(err_e, err_f) AS error, pixels FROM bl"""


@query(_principal_sql())
def bc1_principal_axis(spark: SparkSession, d: str) -> DataFrame:
    return codec.bc1_blocks(adapters.image(spark, d), quality=2)


# --- blending over time with jitter ------------------------------------------------------------------------------------

SHOWN = 2  # frames that each image of the sequence is shown for
_HALTON = [(0.5, 1 / 3)]


def _shown(spark: SparkSession, d: str) -> DataFrame:
    """Each image of the supplied sequence for ``SHOWN`` frames, numbered from 1."""
    return adapters.moving_images(spark, d).withColumn("frame", F.explode(F.array(*[(F.col("frame") - 1) * SHOWN + 1 + k for k in range(SHOWN)])))


@query(_resolve_sql(14, {2 * k: (0.5 - _HALTON[0][0], _HALTON[0][1] - 0.5) for k in range(1, 8)}, f"(SELECT (frame - 1) * {SHOWN} + 1 + s AS frame, x, y, r, g, b, dx, dy, a FROM mov, (SELECT unnest(range({SHOWN})) AS s))"))
def temporal_jitter(spark: SparkSession, d: str) -> DataFrame:
    """The second showing of an image takes the first jitter, a new image resets it."""
    return image.temporal_resolve(_shown(spark, d), 0.25, 64, 64, jitter=True)


@query(f"""WITH RECURSIVE {CELLS}, px AS (SELECT n AS frame, x, y, sum(r) // count(*) AS r, sum(g) // count(*) AS g, sum(b) // count(*) AS b FROM cells GROUP BY n, x, y), fr AS (SELECT DISTINCT frame FROM px),
  df AS (SELECT f.frame, f.frame = (SELECT min(frame) FROM fr) OR EXISTS (SELECT 1 FROM px a WHERE a.frame = f.frame AND NOT EXISTS (SELECT 1 FROM px b WHERE b.frame = f.frame - 1 AND b.x = a.x AND b.y = a.y AND b.r = a.r AND b.g = a.g AND b.b = a.b)) AS new FROM fr f)
  SELECT CAST((frame - 1) * {SHOWN} + 1 + s AS INT) AS frame, CAST(s AS INT) AS unchanged, 0.5::DOUBLE AS jx, round(CASE WHEN s = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE / 3 END, 6) AS jy FROM df, (SELECT unnest(range({SHOWN})) AS s) WHERE new""")
def jitter_sequence(spark: SparkSession, d: str) -> DataFrame:
    found = image.jitter_offsets(image.unchanged_counts(_shown(spark, d)))
    return found.select("frame", "unchanged", F.round("jx", 6).alias("jx"), F.round("jy", 6).alias("jy"))


# --- image files -------------------------------------------------------------------------------------------------------

_MOV = ORACLES["temporal_resolve"].split(", yc AS", 1)[0]


def _frame_pixels(spark: SparkSession, d: str) -> DataFrame:
    return adapters.moving_images(spark, d).select("frame", "x", "y", "r", "g", "b", (F.col("a") * 255).cast("int").alias("a"), ((F.col("x") + F.col("y")) / 4).cast("float").alias("depth"))


@query(f"{_MOV} SELECT CAST(frame AS INT) AS frame, x, y, r::INT AS r, g::INT AS g, b::INT AS b, (a * 255)::INT AS a, (x + y) / 4.0::DOUBLE AS depth FROM mov")
def raw_frame_files(spark: SparkSession, d: str) -> DataFrame:
    """Frames written as raw frame files and read again."""
    path = folders.shared_folder(spark, "frames") + "/raw"
    images.write_images(_frame_pixels(spark, d), path, "rawframe")
    pixels = images.read_images(spark, path, "rawframe", "frame int, x int, y int, r int, g int, b int, a int, depth float")
    return pixels.withColumn("depth", F.col("depth").cast("double"))


@query(f"{_MOV} SELECT CAST(frame AS INT) AS frame, x, y, r::INT AS r, g::INT AS g, b::INT AS b, (a * 255)::INT AS a FROM mov")
def tga_files(spark: SparkSession, d: str) -> DataFrame:
    path = folders.shared_folder(spark, "frames") + "/tga"
    images.write_images(_frame_pixels(spark, d), path, "tga")
    return images.read_images(spark, path, "tga", "frame int, x int, y int, r int, g int, b int, a int")


@query(f"{_MOV} SELECT x, y, sum(r)::BIGINT AS r, sum(g)::BIGINT AS g, sum(b)::BIGINT AS b, count(*) AS frames FROM mov GROUP BY x, y")
def bmp_files(spark: SparkSession, d: str) -> DataFrame:
    path = folders.shared_folder(spark, "frames") + "/bmp"
    images.write_images(_frame_pixels(spark, d), path, "bmp")
    pixels = images.read_images(spark, path, "bmp", "x int, y int, r int, g int, b int")
    return pixels.groupBy("x", "y").agg(*[F.sum(c).alias(c) for c in "rgb"], F.count("*").alias("frames"))


@query(f"""WITH {CELLS}, pl AS (SELECT CAST(i % 64 AS INT) AS x, CAST(i // 64 AS INT) AS y FROM (SELECT unnest(range(4096)) AS i)),
  px AS (SELECT x, y, sum(r) // count(*) AS r, sum(g) // count(*) AS g, sum(b) // count(*) AS b, count(*) AS n FROM cells GROUP BY x, y), wh AS (SELECT x, y, coalesce(r, 0)::INT AS r, coalesce(g, 0)::INT AS g, coalesce(b, 0)::INT AS b, coalesce(n, 0)::DOUBLE AS depth FROM pl LEFT JOIN px USING (x, y))
  SELECT x, y, r, g, b, depth, CAST(trunc(coalesce((depth - (SELECT min(depth) FROM wh)) / nullif((SELECT max(depth) FROM wh) - (SELECT min(depth) FROM wh), 0), 0) * 255 + 0.5) AS INT) AS shade FROM wh""")
def tile_files(spark: SparkSession, d: str) -> DataFrame:
    """An image written as 64 tiles, read as one with its range of depths."""
    c = adapters.cells(spark, d)
    found = c.groupBy("x", "y").agg(*[F.expr(f"cast(sum(cast({v} as bigint)) div count(*) as int)").alias(v) for v in "rgb"], F.count("*").cast("float").alias("depth"))
    places = spark.range(64 * 64).select(F.expr("cast(id % 64 as int)").alias("x"), F.expr("cast(id div 64 as int)").alias("y"))
    whole = places.join(found, ["x", "y"], "left").fillna(0)
    tiles = whole.select(F.expr("cast(x div 8 as int)").alias("tx"), F.expr("cast(y div 8 as int)").alias("ty"), (F.col("x") % 8).alias("x"), (F.col("y") % 8).alias("y"), "r", "g", "b", "depth")
    path = folders.shared_folder(spark, "tiles") + "/raw"
    images.write_images(tiles, path, "rawframe")
    one = files.tile_images(images.read_images(spark, path, "rawframe", "tx int, ty int, x int, y int, r int, g int, b int, depth float"), 8)
    return one.select("x", "y", "r", "g", "b", F.col("depth").cast("double").alias("depth"), "shade")


# --- tiles of images as a stream ---------------------------------------------------------------------------------------


@query(_resolve_sql(7, nudge=" + 1e-9::DOUBLE"))
def stream_tile_blend(spark: SparkSession, d: str) -> DataFrame:
    """The last image of the sequence, blended as a stream with state for each tile; the twin blends whole images.  Both
    round up what is half a millionth but for its last digits, as their sums go in other orders."""
    path = folders.shared_folder(spark, "stream") + "/frames"
    frames = adapters.moving_images(spark, d)
    frames.write.parquet(path)
    stream = spark.readStream.schema(frames.schema).parquet(path)  # all that is there in one batch, so frames are in order
    shown = sequences.run_to_end(tiles.blend_tiles(stream, 0.25, 64, 64), "append")
    last = shown.groupBy("x", "y").agg(F.max_by(F.struct("r", "g", "b", "a"), "frame").alias("v"))
    return last.select("x", "y", *[(F.round(F.col(f"v.{c}") + 1e-9, 6) + 0.0).alias(c) for c in "rgb"], "v.a")


# --- statistics of a trace, vectors, views -----------------------------------------------------------------------------

_PAIRS = f"""{_TO_VIEW}, {_BOUNDS}, {_TILES}, {_RAYS}, pr AS (SELECT ray_id, tx, ty, round(greatest({_SLAB['least']}), 6) AS t0, round(least({_SLAB['greatest']}), 6) AS t1 FROM ray JOIN til USING (tx, ty) JOIN bx USING (block_id)),
  br AS (SELECT ray_id, tx, ty, count(*) AS tested, count(*) FILTER (WHERE t0 <= t1 AND t1 >= 0) AS hit FROM pr GROUP BY ALL)"""


@query(f"""WITH {_PAIRS}, tr AS (SELECT tx, ty, count(*) AS rays FROM ray GROUP BY ALL), tb AS (SELECT tx, ty, count(*) AS boxes FROM til GROUP BY ALL), ts AS (SELECT tx, ty, sum(tested) AS tested, sum(hit) AS hit, count(*) FILTER (WHERE hit > 0) AS met FROM br GROUP BY ALL)
  SELECT tx::INT AS tx, ty::INT AS ty, rays, coalesce(boxes, 0) AS boxes, coalesce(tested, 0)::BIGINT AS tested, coalesce(hit, 0)::BIGINT AS hit, rays - coalesce(met, 0) AS missed FROM tr LEFT JOIN tb USING (tx, ty) LEFT JOIN ts USING (tx, ty)""")
def trace_statistics(spark: SparkSession, d: str) -> DataFrame:
    return trace.trace_statistics(_rays(spark), _binned(spark, d), ["tx", "ty"])


@query(f"WITH {_PAIRS} SELECT hits, count(*) AS rays FROM (SELECT ray.ray_id, coalesce(hit, 0) AS hits FROM ray LEFT JOIN br USING (ray_id)) GROUP BY hits")
def overdraw(spark: SparkSession, d: str) -> DataFrame:
    return trace.overdraw(_rays(spark), _binned(spark, d), ["tx", "ty"])


_VECTOR = {n: [f"embedding[{k}]::DOUBLE" for k in range(1, n + 1)] for n in (2, 4)}
_UNIT = {n: f"sqrt({' + '.join(f'{c} * {c}' for c in v)})" for n, v in _VECTOR.items()}


@query("SELECT vec_id, " + ", ".join(
    f"round({_UNIT[n]}, 6) AS length{n}, round({v[-1]} / {_UNIT[n]}, 6) AS unit{n}, round({' + '.join(f'{a} * {b}' for a, b in zip(v, v[::-1], strict=True))}, 6) AS dot{n}, round(least({v[0]}, {v[-1]}), 6) AS low{n}, round(greatest({v[0]}, {v[-1]}), 6) AS high{n}, round({v[0]} - {v[-1]} / 2, 6) AS moved{n}"
    for n, v in _VECTOR.items()) + " FROM embeddings")
def vectors_2_and_4(spark: SparkSession, d: str) -> DataFrame:
    """Length, unit vector, dot product, least, greatest and difference of vectors with 2 and with 4 components."""
    out = []
    for n in (2, 4):
        v = tuple(F.col("embedding")[k].cast("double") for k in range(n))
        back = v[::-1]
        found = {
            "length": geometry.length(v), "unit": geometry.normalised(v)[-1], "dot": geometry.dot(v, back), "low": geometry.each(F.least, v, back)[0],
            "high": geometry.each(F.greatest, v, back)[0], "moved": geometry.each(lambda a, b: a - b / 2, v, back)[0],
        }
        out += [F.round(c, 6).alias(f"{name}{n}") for name, c in found.items()]
    return adapters.table(spark, d, "embeddings").select("vec_id", *out)


_YAW, _PITCH = "(c_custkey % 63 * 0.1::DOUBLE)", "(c_custkey % 13 * 0.05::DOUBLE - 0.3::DOUBLE)"
_BASIS = {"fx": "-sin(yaw) * cos(pitch)", "fy": "sin(pitch)", "fz": "-cos(yaw) * cos(pitch)", "rx": "cos(yaw)", "ry": "0.0::DOUBLE", "rz": "-sin(yaw)"}
_BASIS |= {"ux": "ry * fz - rz * fy", "uy": "rz * fx - rx * fz", "uz": "rx * fy - ry * fx"}


@query(f"""WITH c AS (SELECT c_custkey, {_YAW} AS yaw, {_PITCH} AS pitch, c_custkey % 7::DOUBLE AS px, c_custkey % 5::DOUBLE AS py FROM customer), v AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in list(_BASIS.items())[:6])} FROM c),
  w AS (SELECT *, {', '.join(f'{_BASIS[n]} AS {n}' for n in ('ux', 'uy', 'uz'))} FROM v) SELECT c_custkey, eye::INT AS eye, round(px + (eye - 0.5::DOUBLE) * 0.06::DOUBLE * rx, 6) + 0.0::DOUBLE AS ox, round(py + (eye - 0.5::DOUBLE) * 0.06::DOUBLE * ry, 6) + 0.0::DOUBLE AS oy,
  round((eye - 0.5::DOUBLE) * 0.06::DOUBLE * rz, 6) + 0.0::DOUBLE AS oz, {', '.join(f'round({n}, 6) + 0.0::DOUBLE AS {n}' for n in _BASIS)} FROM w, (SELECT unnest([0, 1]) AS eye)""")
def customer_views(spark: SparkSession, d: str) -> DataFrame:
    """Both eyes of a view for each customer."""
    k = F.col("c_custkey")
    rows = adapters.table(spark, d, "customer").select(k, (k % 7).cast("double").alias("ox"), (k % 5).cast("double").alias("oy"), F.lit(0.0).alias("oz"))
    views = geometry.stereo_views(rows, k % 63 * 0.1, k % 13 * 0.05 - 0.3, 0.06)
    return views.select("c_custkey", "eye", *[(F.round(c, 6) + 0.0).alias(c) for c in ("ox", "oy", "oz", *_BASIS)])
