"""Further registered queries: scenes, masks, textures, files and ids, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, color, geometry, hashing, scalar
from ..operators import capture, codec, metrics, scene, sorting, text, trace, voxel
from ..sources import adapters, files
from .catalogue import _MIP, _SEEN, _inverse_sql, BOXES, CAMERA, CELLS, CENTRES, HALVES, IMAGE, LEAVES, POINTS, query

SKY = 10  # the mip of the sky


def _cols(*names: str) -> tuple:
    return tuple(F.col(n) for n in names)


# --- capture -----------------------------------------------------------------------------------------------------------

_OFFSETS = "off AS (SELECT id, " + ", ".join(f"({_inverse_sql(b, n)} * 2 - 1) * 0.05::DOUBLE AS {c}" for c, b, n in (("x", 2, 31), ("y", 3, 20), ("z", 5, 14))) + " FROM (SELECT unnest(range({count})) AS id))"
_AXES = [f"{name}{c}" for name in "fru" for c in "xyz"]
_FACES = "face AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, " + ", ".join(f"{float(v)!r}::DOUBLE" for axis in face for v in axis) + ")" for k, face in enumerate(capture.FACES)) + f") t(face, {', '.join(_AXES)}))"


@query(f"WITH {_OFFSETS.format(count=32)} SELECT id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM off")
def sample_offsets(spark: SparkSession, d: str) -> DataFrame:
    return capture.sample_offsets(spark, capture.OFFSETS_MOST, 0.05).select("id", *[F.round(c, 6).alias(c) for c in "xyz"])


@query(f"WITH {_OFFSETS.format(count=17)}, {_FACES} SELECT CAST(id * 6 + face AS INT) AS view_id, round(x, 6) AS ox, round(y, 6) AS oy, round(z, 6) AS oz, {', '.join(_AXES)} FROM off, face")
def capture_views(spark: SparkSession, d: str) -> DataFrame:
    views = capture.cube_views(capture.sample_offsets(spark, 17, 0.05))
    return views.withColumns({f"o{c}": F.round(f"o{c}", 6) for c in "xyz"})


@query(f"""WITH {CELLS}, {_OFFSETS.format(count=17)}, {_FACES}, p AS (SELECT k, n, (k * 7 + n) % 102 AS view_id, (x + 0.5::DOUBLE) * 0.015625::DOUBLE * 2 - 1 AS sx, (y + 0.5::DOUBLE) * 0.015625::DOUBLE * 2 - 1 AS sy, 1.0::DOUBLE / nullif(z * 0.08::DOUBLE + 0.1::DOUBLE, 0) AS t, r, g, b FROM cells)
  SELECT k, n, CAST(view_id AS INT) AS view_id, {', '.join(f'round(off.{c} + (f{c} + r{c} * sx - u{c} * sy) * t, 6) AS p{c}' for c in 'xyz')}, {', '.join(f'CAST(trunc(pow({c} / 255.0::DOUBLE, 2.2::DOUBLE) * 255 + 0.5) AS INT) AS {c}' for c in 'rgb')}
  FROM p JOIN off ON off.id = view_id // 6 JOIN face ON face = view_id % 6""")
def cube_face_samples(spark: SparkSession, d: str) -> DataFrame:
    pixels = adapters.cells(spark, d).select("k", "n", ((F.col("k") * 7 + F.col("n")) % 102).cast("int").alias("view_id"), "x", "y", F.col("z").alias("depth"), "r", "g", "b")
    rows = capture.cube_face_samples(pixels, capture.cube_views(capture.sample_offsets(spark, 17, 0.05)), 64, 0.08, 0.1, srgb=True)
    return rows.withColumns({c: F.round(c, 6) for c in ("px", "py", "pz")})


@query(f"""WITH {CELLS}, {IMAGE}, {POINTS}, t AS (SELECT vec_id, CAST(greatest(least(floor((x * 4 + 0.5) * 64), 63), 0) AS INT) AS tx, CAST(greatest(least(floor((y * 4 + 0.5) * 64), 63), 0) AS INT) AS ty, z FROM pts)
  SELECT vec_id, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b, round(abs(z) * (coalesce(r, 0) / 255.0::DOUBLE * 0.5), 6) AS glyph FROM t LEFT JOIN img ON img.x = tx AND img.y = ty""")
def textured_points(spark: SparkSession, d: str) -> DataFrame:
    points = adapters.points(spark, d).select("vec_id", (F.col("x") * 4 + 0.5).alias("u"), (F.col("y") * 4 + 0.5).alias("v"), F.abs("z").alias("ink"))
    rows = capture.textured(points, adapters.image(spark, d), "u", "v", 64, 64)
    ink = capture.glyph_colour(F.col("r") / 255.0, (F.col("ink"), F.col("ink"), F.col("ink"), F.lit(0.5)))
    return rows.select("vec_id", "r", "g", "b", F.round(ink[0], 6).alias("glyph"))


# --- samples and filters -----------------------------------------------------------------------------------------------

_LO, _HI = "CAST(-0.75 AS DOUBLE)", "CAST(0.75 AS DOUBLE)"


@query(f"""WITH {POINTS}, m AS (SELECT *, {_MIP} AS own FROM pts), s AS (SELECT *, least({', '.join(f'greatest({_LO} / nullif({c}, 0), {_HI} / nullif({c}, 0))' for c in 'xyz')}) AS t FROM m)
  SELECT vec_id, CASE WHEN own < {SKY} THEN own ELSE {SKY} END AS mip, own >= {SKY} AS sky, {', '.join(f'round(CASE WHEN own < {SKY} THEN {c} ELSE {c} * t END, 6) AS {c}' for c in 'xyz')} FROM s""")
def sky_samples(spark: SparkSession, d: str) -> DataFrame:
    p = _cols("x", "y", "z")
    own = geometry.mip_of(p, CENTRES, HALVES)
    (x, y, z), mip = geometry.sky_sample(p, own, p, (F.lit(0.0),) * 3, SKY, -0.75, 0.75)
    return adapters.points(spark, d).select("vec_id", mip.alias("mip"), (own >= SKY).alias("sky"), *[F.round(v, 6).alias(n) for n, v in zip("xyz", (x, y, z), strict=True)])


@query(f"WITH {POINTS}, m AS (SELECT vec_id, {_MIP} AS mip FROM pts) SELECT vec_id, mip FROM m WHERE mip < {SKY}")
def below_sky(spark: SparkSession, d: str) -> DataFrame:
    return adapters.points(spark, d).select("vec_id", geometry.mip_of(_cols("x", "y", "z"), CENTRES, HALVES).alias("mip")).where(F.col("mip") < SKY)


def _out(test: str) -> str:
    return "(" + " AND ".join(test.format(k=k) for k in range(8)) + ")"


_SIDES = {"right": "r{k} > d{k} * " + repr(CAMERA.tan_x), "left": "-r{k} > d{k} * " + repr(CAMERA.tan_x), "top": "u{k} > d{k} * " + repr(CAMERA.tan_y), "bottom": "-u{k} > d{k} * " + repr(CAMERA.tan_y)}


@query(f"WITH {POINTS}, {BOXES}, {_SEEN} SELECT count(*) AS seen, " + ", ".join(f'count(*) FILTER (WHERE {_out(t)}) AS "{n}"' for n, t in _SIDES.items()) + f", count(*) FILTER (WHERE NOT ({' OR '.join(map(_out, _SIDES.values()))})) AS kept FROM seen")
def cull_statistics(spark: SparkSession, d: str) -> DataFrame:
    return trace.cull_statistics(adapters.boxes(spark, d), CAMERA)


@query(f"WITH {CELLS} SELECT k, n, r FROM cells WHERE r / 255.0::DOUBLE >= 0.8")
def alpha_test(spark: SparkSession, d: str) -> DataFrame:
    return scene.opaque(adapters.cells(spark, d).withColumn("alpha", F.col("r") / F.lit(255.0)), "alpha").select("k", "n", "r")


@query(f"WITH {POINTS} SELECT vec_id, x * 4 + 0.5 BETWEEN 0 AND 1 AND y * 4 + 0.5 BETWEEN 0 AND 1 AS inside FROM pts")
def uv_in_range(spark: SparkSession, d: str) -> DataFrame:
    return adapters.points(spark, d).select("vec_id", geometry.uv_inside(F.col("x") * 4 + 0.5, F.col("y") * 4 + 0.5).alias("inside"))


@query(f"WITH {CELLS} SELECT k, n, x, y, x < 32 AND y < 32 AS valid FROM cells")
def out_of_grid(spark: SparkSession, d: str) -> DataFrame:
    """Rows stay; those outside are counted as they pass."""
    rows = adapters.cells(spark, d).select("k", "n", "x", "y", ((F.col("x") < 32) & (F.col("y") < 32)).alias("valid"))
    return metrics.observed(rows, "grid", errors=~F.col("valid"))[0]


# --- masks, words and ids ----------------------------------------------------------------------------------------------


def _half(rows: DataFrame, odd: int) -> DataFrame:
    blocks = voxel.block_masks(voxel.leaves(rows.where(F.col("n") % 2 == odd)))
    return blocks.select("bx", "by", "bz", *[F.col(f"presence{k}").alias(f"m{odd}{k}") for k in (0, 1)])


def _half_sql(odd: int) -> str:
    bit = lambda k: f"bit_or(CASE WHEN c // 32 = {k} THEN 1::BIGINT << (c % 32) ELSE 0 END)"
    return f"""h{odd} AS (SELECT x >> 2 AS bx, y >> 2 AS "by", z >> 2 AS bz, {bit(0)} AS a, {bit(1)} AS b FROM (SELECT x, y, z, (x & 3) | ((y & 3) << 2) | ((z & 3) << 4) AS c FROM cells WHERE n % 2 = {odd}) GROUP BY 1, 2, 3)"""


@query(f"""WITH {CELLS}, {_half_sql(0)}, {_half_sql(1)}, j AS (SELECT bx, "by", bz, coalesce(h0.a, 0) AS a0, coalesce(h0.b, 0) AS b0, coalesce(h1.a, 0) AS a1, coalesce(h1.b, 0) AS b1 FROM h0 FULL JOIN h1 USING (bx, "by", bz))
  SELECT bx, "by", bz, CAST(bit_count(a0 & a1) + bit_count(b0 & b1) AS INT) AS both, CAST(bit_count(a0 | a1) + bit_count(b0 | b1) AS INT) AS either, CAST(bit_count(a0 & ~a1) + bit_count(b0 & ~b1) AS INT) AS first_only, a0 & a1 AS both0, b0 & b1 AS both1 FROM j""")
def mask_algebra(spark: SparkSession, d: str) -> DataFrame:
    cells = adapters.cells(spark, d)
    j = _half(cells, 0).join(_half(cells, 1), ["bx", "by", "bz"], "full")
    a, b = (tuple(F.coalesce(f"m{odd}{k}", F.lit(0)) for k in (0, 1)) for odd in (0, 1))
    both = bits.both_masks(a, b)
    return j.select(
        "bx", "by", "bz", bits.mask_size(both).alias("both"), bits.mask_size(bits.either_mask(a, b)).alias("either"), bits.mask_size(bits.mask_without(a, b)).alias("first_only"), both[0].alias("both0"), both[1].alias("both1")
    )


@query("SELECT user_id, bit_and(m) AS all_bits, bit_or(m) AS any_bits, min(m) AS least, max(m) AS greatest, sum(m)::BIGINT AS total, arg_max(m, event_id) AS last FROM (SELECT user_id, event_id, (event_id % 255)::BIGINT AS m FROM events) GROUP BY user_id")
def mask_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = adapters.table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 255).alias("m"))
    return metrics.mask_totals(rows, "user_id", "m", "event_id")


@query("""SELECT o_orderkey, (o_orderkey + 15) & -16 AS up16, (o_orderkey + 4095) & -4096 AS up4096, o_orderkey << 20 AS mb, (o_orderkey * 10000000) >> 20 AS in_mb, (o_orderkey * 10000000) >> 30 AS in_gb, o_orderkey << 30 AS gb, (o_orderkey + 9007199254740993 + 6) // 7 AS groups,
  round(o_orderkey / 3579545.0::DOUBLE, 9) AS secs, round(o_orderkey * 0.001::DOUBLE * (180.0::DOUBLE / 3.1415926::DOUBLE), 6) AS deg FROM orders""")
def sizes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return adapters.table(spark, d, "orders").select(
        "o_orderkey", bits.round_up(k, 16).alias("up16"), bits.round_up(k, 4096).alias("up4096"), scalar.from_unit(k, "MB").alias("mb"), scalar.in_unit(k * 10000000, "MB").alias("in_mb"), scalar.in_unit(k * 10000000, "GB").alias("in_gb"),
        scalar.from_unit(k, "GB").alias("gb"), bits.group_count(k + 9007199254740993, 7).alias("groups"), F.round(scalar.seconds(k, 3579545.0), 9).alias("secs"), F.round(scalar.degrees(k * 0.001), 6).alias("deg"),
    )


@query(f"""WITH {POINTS}, w AS (SELECT vec_id, ((vec_id * 7919) % 65536 << 16) | (vec_id * 104729 % 65536) AS p, (vec_id * 2654435761) % 4294967296 AS q, (vec_id * 40503 + 12345) % 4294967296 AS c FROM pts)
  SELECT vec_id, CAST(p >> 16 AS INT) AS px, CAST(p & 65535 AS INT) AS py, CAST(q >> 24 AS INT) AS x, CAST((q >> 16) & 255 AS INT) AS y, CAST((q >> 8) & 255 AS INT) AS w, CAST(q & 255 AS INT) AS h,
  {', '.join(f'round(((c >> {s}) & 255) / 255.0::DOUBLE, 6) AS {n}' for n, s in (('r', 24), ('g', 16), ('b', 8), ('a', 0)))} FROM w""")
def unpacked_characters(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vec_id")
    rows = adapters.points(spark, d).select("vec_id", bits.put((v * 7919 % 65536, 16), (v * 104729 % 65536, 0)).alias("p"), (v * 2654435761 % 4294967296).alias("q"), ((v * 40503 + 12345) % 4294967296).alias("c"))
    fields = bits.unpack_character(F.col("p"), F.col("q"), F.col("c"))
    return rows.select("vec_id", *[(F.round(f, 6) if n in "rgba" else f).alias(n) for n, f in fields.items()])


@query(f"WITH {CELLS} SELECT k, n, (CAST((n & 1) * 4 + n % 3 AS BIGINT) << 29) | (x::BIGINT << 20) | (y::BIGINT << 11) | z AS address FROM cells")
def onion_addresses(spark: SparkSession, d: str) -> DataFrame:
    face = bits.face_id(F.col("n").bitwiseAND(F.lit(1)), F.col("n") % 3)
    return adapters.cells(spark, d).select("k", "n", bits.onion_block_address(face, *_cols("x", "y", "z")).alias("address"))


@query("SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS id FROM customer")
def dense_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = adapters.table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return sorting.dense_ids(rows, "c_mktsegment", "c_custkey", 1 << 40)


@query("SELECT r_regionkey, r_name FROM region")
def within_capacity(spark: SparkSession, d: str) -> DataFrame:
    """Sixteen inputs at most, or the query fails."""
    return sorting.at_most(adapters.table(spark, d, "region").select("r_regionkey", "r_name"), 16, "inputs")


@query("SELECT p_partkey, p_size FROM part ORDER BY p_size, p_partkey")
def sorted_parts(spark: SparkSession, d: str) -> DataFrame:
    return sorting.ascending(adapters.table(spark, d, "part").select("p_partkey", "p_size"), "p_size", ties="p_partkey")


@query("SELECT p_partkey, p_size * 31 % 17 AS key FROM part ORDER BY key, p_partkey")
def sorted_by_key(spark: SparkSession, d: str) -> DataFrame:
    rows = adapters.table(spark, d, "part").select("p_partkey", (F.col("p_size") * 31 % 17).alias("key"))
    return sorting.ascending(rows, F.col("key"), ties="p_partkey")


# --- scenes ------------------------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey AS triangle, l_linenumber AS corner, l_partkey AS position, p.p_size::DOUBLE AS x, p.p_retailprice AS y, l_suppkey AS uv, s.s_nationkey AS u, l_suppkey % 40 AS normal, n.n_regionkey AS nx
  FROM lineitem JOIN part p ON p.p_partkey = l_partkey LEFT JOIN nation n ON n.n_nationkey = l_suppkey % 40 LEFT JOIN supplier s ON s.s_suppkey = l_suppkey""")
def triangle_vertices(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: adapters.table(spark, d, n)
    corners = t("lineitem").select(F.col("l_orderkey").alias("triangle"), F.col("l_linenumber").alias("corner"), F.col("l_partkey").alias("position"), F.col("l_suppkey").alias("uv"), (F.col("l_suppkey") % 40).alias("normal"))
    positions = t("part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    normals = t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("nx"))
    uvs = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("u"))
    return scene.triangle_vertices(corners, positions, normals, uvs)


def _eyes_sql() -> str:
    rows = [(k, *eye.origin, *eye.forward, *eye.right, *eye.up, eye.tan_x, eye.tan_y) for k, eye in enumerate(CAMERA.eyes(0.06))]
    names = ["eye", *[f"{v}{c}" for v in ("o", "f", "r", "u") for c in "xyz"], "tan_x", "tan_y"]
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"{v!r}::DOUBLE" if i else str(v) for i, v in enumerate(r)) + ")" for r in rows) + f") t({', '.join(names)})"


@query(_eyes_sql())
def eye_views(spark: SparkSession, d: str) -> DataFrame:
    return geometry.view_rows(spark, CAMERA.eyes(0.06))


@query("""SELECT id, round(sqrt(1 - z * z) * cos(a), 6) AS x, round(sqrt(1 - z * z) * sin(a), 6) AS y, round(z, 6) AS z FROM (SELECT p_partkey AS id, 2 * pi() * list_sum(list_transform(range(31), lambda k: ((p_partkey + 1) // (2 ** k)::BIGINT % 2) / (2.0 ** (k + 1)))) AS a,
  2 * list_sum(list_transform(range(20), lambda k: ((p_partkey + 1) // (3 ** k)::BIGINT % 3) / (3.0 ** (k + 1)))) - 1 AS z FROM part)""")
def sphere_directions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    x, y, z = hashing.sphere(hashing.halton(k, 2), hashing.halton(k, 3))
    return adapters.table(spark, d, "part").select(k.alias("id"), F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(z, 6).alias("z"))


# --- images ------------------------------------------------------------------------------------------------------------


def _texture_sql(quality: int) -> str:
    """Coded tiles of the image and its halvings, level by level."""
    ctes, out, start, width, level = [CELLS, IMAGE], [], 0, 64, 0
    while width >= 4:
        src = f"i{level}" if level else "img"
        if level:
            before = f"i{level - 1}" if level > 1 else "img"
            ctes.append(f"{src} AS (SELECT CAST(x // 2 AS INT) AS x, CAST(y // 2 AS INT) AS y, " + ", ".join(f"CAST(sum({c}) // count(*) AS INT) AS {c}" for c in "rgb") + f" FROM {before} GROUP BY 1, 2)")
        if quality:
            ends = ", ".join(f"{f}({c}, (r + 2 * g + b)::BIGINT * 16777216 + r * 65536 + g * 256 + b) OVER w AS {c}{k}" for c in "rgb" for k, f in ((0, "arg_min"), (1, "arg_max")))
        else:
            ends = ", ".join(f"{f}({c}) OVER w AS {c}{k}" for c in "rgb" for k, f in ((0, "min"), (1, "max")))
        ctes.append(f"e{level} AS (SELECT *, x // 4 AS tx, y // 4 AS ty, {ends} FROM {src} WINDOW w AS (PARTITION BY x // 4, y // 4))")
        parts = ("{c}0", "{c}1", "trunc((2 * {c}0 + {c}1) / 3)::INT", "trunc(({c}0 + 2 * {c}1) / 3)::INT")
        ctes.append(f"q{level} AS (SELECT *, {', '.join('(' + ' + '.join(f'({c} - ({p.format(c=c)})) * ({c} - ({p.format(c=c)}))' for c in 'rgb') + f')::BIGINT AS d{k}' for k, p in enumerate(parts))} FROM e{level})")
        tiles = (width + 3) // 4
        out.append(
            f"SELECT {level} AS level, CAST(tx AS INT) AS tx, CAST(ty AS INT) AS ty, any_value((r0::BIGINT << 16) | (g0::BIGINT << 8) | b0) AS end0, any_value((r1::BIGINT << 16) | (g1::BIGINT << 8) | b1) AS end1,"
            f" bit_or((list_position([d0, d1, d2, d3], least(d0, d1, d2, d3)) - 1)::BIGINT << (2 * (x % 4 + 4 * (y % 4)))) AS indexes, sum(least(d0, d1, d2, d3))::BIGINT AS error, count(*) AS pixels,"
            f" {start} + (CAST(ty AS BIGINT) * {tiles} + tx) * 8 AS at FROM q{level} GROUP BY tx, ty"
        )
        start, width, level = start + 8 * tiles * tiles, width >> 1, level + 1
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join(out).replace(" AS at ", ' AS "at" ')


@query(_texture_sql(0))
def texture_levels(spark: SparkSession, d: str) -> DataFrame:
    return codec.texture(adapters.image(spark, d), 64)


@query(_texture_sql(1))
def texture_levels_fine(spark: SparkSession, d: str) -> DataFrame:
    return codec.texture(adapters.image(spark, d), 64, quality=1)


@query(f"""WITH {CELLS}, {IMAGE}, t AS (SELECT x, y, r, g, b, (r * 3 + g)::DOUBLE * 0.25 AS depth FROM img), s AS (SELECT min(depth) AS lo, max(depth) AS hi FROM t)
  SELECT x, y, r, g, b, depth, CAST(trunc(coalesce((depth - lo) / nullif(hi - lo, 0), 0.0) * 255 + 0.5) AS INT) AS shade FROM t, s""")
def tile_depths(spark: SparkSession, d: str) -> DataFrame:
    tiles = adapters.image(spark, d).select(
        *[F.expr(f"{c} div 8").cast("int").alias("t" + c) for c in "xy"], *[(F.col(c) % 8).alias(c) for c in "xy"], "r", "g", "b", ((F.col("r") * 3 + F.col("g")).cast("double") * 0.25).alias("depth")
    )
    return files.tile_images(tiles, 8)


# --- files as text -----------------------------------------------------------------------------------------------------


def _shape_sql(shapes: tuple[tuple[int, ...], ...]) -> str:
    """Lines of the objects of all boxes, keyed by block."""
    corners, n = len(shapes[0]), len(shapes)
    rows = ", ".join(f"({s}, {i}, {v & 1}, {v >> 1 & 1}, {v >> 2 & 1})" for s, shape in enumerate(shapes) for i, v in enumerate(shape))
    ids = " || ' ' || ".join(f"(block_id * {corners * n} + s * {corners} + {k + 1})::VARCHAR" for k in range(corners))
    return f"""WITH {POINTS}, {BOXES}, t(s, c, i, j, k) AS (VALUES {rows}) SELECT block_id, s * {corners + 1} + c + 2 AS line, printf('v %.4f %.4f %.4f', CASE i WHEN 1 THEN x1 ELSE x0 END, CASE j WHEN 1 THEN y1 ELSE y0 END, CASE k WHEN 1 THEN z1 ELSE z0 END) AS text FROM bx, t
  UNION ALL SELECT block_id, s * {corners + 1} + {corners + 2}, 'f ' || {ids} FROM bx, t WHERE c = 0 UNION ALL SELECT block_id, 0, 'usemtl mat' || block_id FROM bx UNION ALL SELECT block_id, 1, 'o obj' || block_id FROM bx"""


@query(_shape_sql(text.BOX_TRIANGLES))
def plot_triangles(spark: SparkSession, d: str) -> DataFrame:
    return text.obj_shapes(text.box_shapes(adapters.boxes(spark, d), "block_id", wireframe=False), "block_id", 3, 12)


@query(_shape_sql(text.BOX_EDGES))
def plot_lines(spark: SparkSession, d: str) -> DataFrame:
    return text.obj_shapes(text.box_shapes(adapters.boxes(spark, d), "block_id", wireframe=True), "block_id", 2, 12)


@query(f"WITH {POINTS} SELECT vec_id, l AS line, CASE l WHEN 0 THEN 'usemtl mat' || vec_id WHEN 1 THEN 'o obj' || vec_id WHEN 2 THEN printf('v %.4f %.4f %.4f', x, y, z) ELSE 'f ' || (vec_id + 1) END AS text FROM pts, (SELECT CAST(unnest(range(4)) AS INT) AS l)")
def plot_points(spark: SparkSession, d: str) -> DataFrame:
    return text.obj_shapes(text.point_shapes(adapters.points(spark, d), "vec_id"), "vec_id", 1, 1)


@query("""WITH c AS (SELECT c_custkey AS id, c_custkey % 256 AS r, c_custkey * 3 % 256 AS g, c_custkey * 7 % 256 AS b, 255 AS a FROM customer) SELECT id, l AS line, CASE l WHEN 0 THEN 'newmtl mat' || id WHEN 1 THEN printf('kd %.6f %.6f %.6f', r / 255.0::DOUBLE, g / 255.0::DOUBLE, b / 255.0::DOUBLE) ELSE printf('d %.6f', a / 255.0::DOUBLE) END AS text
  FROM c, (SELECT CAST(unnest(range(3)) AS INT) AS l)""")
def plot_materials(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    objects = adapters.table(spark, d, "customer").select(k.alias("id"), (k % 256).alias("r"), (k * 3 % 256).alias("g"), (k * 7 % 256).alias("b"), F.lit(color.COLORS["white"][3]).alias("a"))
    return text.mtl_objects(objects, "id")


@query(r"""WITH g AS (SELECT n_nationkey * 7 AS id, n_nationkey * 9 AS x, n_regionkey * 30 AS y, n_nationkey % 13 + 1 AS width, n_regionkey + 8 AS height, n_regionkey - 2 AS xoffset, 2 - n_regionkey AS yoffset, n_nationkey % 11 + 2 AS xadvance FROM nation)
  SELECT CAST(i AS INT) AS id, chr(9) || printf('{ %3d, %3d, %2d, %2d, %2d, %2d, %2d },', coalesce(x, 0), coalesce(y, 0), coalesce(width, 0), coalesce(height, 0), coalesce(xoffset, 0), coalesce(yoffset, 0), coalesce(xadvance, 0)) AS line FROM (SELECT unnest(range(256)) AS i) LEFT JOIN g ON g.id = i""")
def font_table(spark: SparkSession, d: str) -> DataFrame:
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    glyphs = adapters.table(spark, d, "nation").select(
        (n * 7).alias("id"), (n * 9).alias("x"), (r * 30).alias("y"), (n % 13 + 1).alias("width"), (r + 8).alias("height"), (r - 2).alias("xoffset"), (F.lit(2) - r).alias("yoffset"), (n % 11 + 2).alias("xadvance")
    )
    return text.font_table(glyphs)


@query("""WITH o AS (SELECT r_name AS section, n_name AS key, n_nationkey::VARCHAR AS value FROM nation JOIN region ON r_regionkey = n_regionkey), u AS (SELECT r_name AS section, lower(n_name) AS key, 'new' AS value FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'own', 'title', 'x'),
  w AS (SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM u WHERE lower(u.section) = lower(o.section) AND lower(u.key) = lower(o.key)) UNION ALL SELECT * FROM u) SELECT DISTINCT section, '' AS key, '[' || section || ']' AS line FROM w UNION ALL SELECT section, key, key || '=' || value FROM w""")
def settings_written(spark: SparkSession, d: str) -> DataFrame:
    n = adapters.table(spark, d, "nation").join(adapters.table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    old = n.select(F.col("r_name").alias("section"), F.col("n_name").alias("key"), F.col("n_nationkey").cast("string").alias("value"))
    new = n.where("n_nationkey % 3 = 0").select(F.col("r_name").alias("section"), F.lower("n_name").alias("key"), F.lit("new").alias("value"))
    new = new.unionByName(spark.createDataFrame([("own", "title", "x")], "section string, key string, value string"))
    return text.settings_lines(text.write_setting(old, new))


@query(r"""SELECT page_id, regexp_replace(url, '\.[^./\\]*$', '') AS bare, CASE WHEN url = '' THEN 'frame.df' ELSE regexp_replace(url, '[/\\]+$', '') || '/frame.df' END AS path, regexp_matches(url, '\.html$') AS is_html, hex(encode(regexp_replace(left(html, 0) || 'é€' || page_id, '[^\x00-\xFF]', '?', 'g'))) = hex(encode('é?' || page_id)) AS ansi FROM pages""")
def more_path_parts(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    same = F.decode(scalar.ansi(F.concat(F.lit("é€"), F.col("page_id").cast("string"))), "ISO-8859-1") == F.concat(F.lit("é?"), F.col("page_id").cast("string"))
    return adapters.table(spark, d, "pages").select("page_id", scalar.without_extension(u).alias("bare"), scalar.make_path(u, F.lit("frame.df")).alias("path"), (scalar.file_extension(u) == "html").alias("is_html"), same.alias("ansi"))
