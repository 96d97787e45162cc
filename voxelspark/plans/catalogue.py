"""Registered queries: each applies operators to a supplied table, whole, and has a DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, color, geometry, hashing, scalar
from ..operators import codec, fit, image, kernels, metrics, scene, sorting, text, timeline, trace, voxel
from ..sources import adapters, generators
from ..streaming import sequences

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

RATE = 7  # frames of a sequence: days of a week
CAMERA = geometry.Camera.looking((0.0, 0.0, 0.0), 0.1, -0.05, 1.2, 0.9)
WIDTH, HEIGHT, TILE = 64, 48, 8
ONION = geometry.Onion()
CENTRES = [(0.02 * k, -0.01 * k, 0.01 * k) for k in range(geometry.MIPS)]
HALVES = [0.02 * 1.35**k for k in range(geometry.MIPS)]

# Parts of the SQL twins.
CELLS = """cells AS (SELECT CAST(trunc(l_quantity) AS INT) AS x, CAST(trunc(l_extendedprice / 2000) AS INT) AS y, CAST(trunc(l_discount * 100 + 0.5) AS INT) AS z,
  l_linenumber % 16 AS mip, CAST(l_partkey % 256 AS INT) AS r, CAST(l_suppkey % 256 AS INT) AS g, l_linenumber * 31 % 256 AS b, l_orderkey AS k, l_linenumber AS n FROM lineitem)"""
LEAVES = "leaves AS (SELECT x, y, z, count(*) AS cnt, sum(r)::BIGINT AS r_sum, sum(g)::BIGINT AS g_sum, sum(b)::BIGINT AS b_sum FROM cells GROUP BY ALL)"
POINTS = "pts AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"
IMAGE = "img AS (SELECT x, y, CAST(sum(r) // count(*) AS INT) AS r, CAST(sum(g) // count(*) AS INT) AS g, CAST(sum(b) // count(*) AS INT) AS b FROM cells GROUP BY x, y)"
FRAMES = "fr AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS frame, user_id, event_type, CAST(count(*) AS INT) AS n FROM events GROUP BY ALL)"
BOXES = "bx AS (SELECT vec_id AS block_id, x - 0.03 AS x0, x + 0.03 AS x1, y - 0.03 AS y0, y + 0.03 AS y1, z - 1.0 - 0.03 AS z0, z - 1.0 + 0.03 AS z1 FROM pts)"
DRAWS = "dr AS (SELECT event_id AS frame_id, user_id, CAST(round(value * 100) AS BIGINT) AS draw_us, CAST(1 << (length(event_type) % 4) AS INT) AS events FROM events)"
MASKS = """masks AS (SELECT x >> 2 AS bx, y >> 2 AS "by", z >> 2 AS bz, bit_or(CASE WHEN c < 32 THEN 1::BIGINT << c ELSE 0 END) AS presence0,
  bit_or(CASE WHEN c >= 32 THEN 1::BIGINT << (c - 32) ELSE 0 END) AS presence1, sum(cnt)::BIGINT AS points, CAST(bit_count(presence0) + bit_count(presence1) AS INT) AS cells
  FROM (SELECT *, (x & 3) | ((y & 3) << 2) | ((z & 3) << 4) AS c FROM leaves) GROUP BY 1, 2, 3)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- capture -----------------------------------------------------------------------------------------------------------


@query(f"WITH {CELLS}, {LEAVES}, {MASKS} SELECT cells, count(*) AS blocks, sum(points)::BIGINT AS points FROM masks GROUP BY cells")
def voxel_occupancy(spark: SparkSession, d: str) -> DataFrame:
    return voxel.occupancy(voxel.block_masks(voxel.leaves(adapters.cells(spark, d))))


@query(f'WITH {CELLS}, {LEAVES}, {MASKS} SELECT bx, "by", bz, presence0, presence1, points, cells, CASE WHEN cells <= 4 THEN 0 WHEN cells <= 8 THEN 1 WHEN cells <= 16 THEN 2 WHEN cells <= 32 THEN 3 ELSE 4 END AS bucket, (bx::BIGINT << 18) | ("by" << 9) | bz AS address FROM masks')
def block_presence_masks(spark: SparkSession, d: str) -> DataFrame:
    blocks = voxel.block_masks(voxel.leaves(adapters.cells(spark, d)))
    return blocks.withColumn("bucket", voxel.bucket_of(F.col("cells"))).withColumn("address", bits.mip_block_address(F.lit(0), F.col("bx"), F.col("by"), F.col("bz")))


@query(f"WITH {CELLS}, {LEAVES} SELECT lv AS level, count(*) AS nodes, sum(n)::BIGINT AS samples FROM (SELECT lv, x >> (6 - lv) AS x, y >> (6 - lv) AS y, z >> (6 - lv) AS z, sum(cnt) AS n FROM leaves, (SELECT CAST(unnest(range(7)) AS INT) AS lv) GROUP BY ALL) GROUP BY lv")
def octree_levels(spark: SparkSession, d: str) -> DataFrame:
    return voxel.octree_levels(adapters.cells(spark, d), 6)


@query(f"WITH {CELLS}, {LEAVES} SELECT x, y, z, cnt, CAST(r_sum // cnt AS INT) AS r, CAST(g_sum // cnt AS INT) AS g, CAST(b_sum // cnt AS INT) AS b FROM leaves")
def leaf_color_avg(spark: SparkSession, d: str) -> DataFrame:
    return voxel.leaf_colors(voxel.leaves(adapters.cells(spark, d)))


@query(f"WITH {CELLS} SELECT (z & 1) * 4 + (y & 1) * 2 + (x & 1) AS octant, count(*) AS samples FROM cells GROUP BY 1")
def octant_counts(spark: SparkSession, d: str) -> DataFrame:
    return adapters.cells(spark, d).groupBy(bits.octant(F.col("x"), F.col("y"), F.col("z")).alias("octant")).agg(F.count("*").alias("samples"))


@query(f"WITH {CELLS} SELECT count(*) AS seen, count(*) FILTER (WHERE x < 32 AND y < 32) AS passed, count(*) FILTER (WHERE NOT (x < 32 AND y < 32)) AS failed FROM cells")
def in_grid_counts(spark: SparkSession, d: str) -> DataFrame:
    return voxel.in_and_passed(adapters.cells(spark, d), (F.col("x") < 32) & (F.col("y") < 32))


@query(f"WITH {CELLS} SELECT k, n, (x::BIGINT << 20) | (y::BIGINT << 8) | r AS row0, (z::BIGINT << 20) | (g::BIGINT << 12) | (b::BIGINT << 4) | mip AS row1, x, y, z, mip, r, g, b FROM cells")
def sample_pack_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    c = adapters.cells(spark, d)
    row0, row1 = bits.pack_mip_sample(*[F.col(n) for n in ("x", "y", "z", "mip", "r", "g", "b")])
    packed = c.select("k", "n", row0.alias("row0"), row1.alias("row1"))
    return packed.select("*", *[v.alias(n) for n, v in bits.unpack_mip_sample(F.col("row0"), F.col("row1")).items()])


@query(
    f"WITH {CELLS} SELECT k, n, (CAST(n & 1 AS BIGINT) << 31) | (CAST(n % 3 AS BIGINT) << 29) | (x::BIGINT << 20) | (y::BIGINT << 11) | (z * 16 + mip) AS row0, (r::BIGINT << 24) | (g::BIGINT << 16) | (b::BIGINT << 8) | ((x & 3) << 4) | ((y & 3) << 2) | (z & 3) AS row1,"
    " n & 1 AS sign, n % 3 AS axis, x AS bx, y AS \"by\", z * 16 + mip AS bz, r, g, b, x & 3 AS cx, y & 3 AS cy, z & 3 AS cz FROM cells"
)
def onion_pack_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    c = adapters.cells(spark, d).withColumn("bz", F.col("z") * 16 + F.col("mip"))
    three = F.lit(3)
    cell = tuple(F.col(a).bitwiseAND(three) for a in "xyz")
    row0, row1 = bits.pack_onion_sample(F.col("n").bitwiseAND(F.lit(1)), F.col("n") % 3, (F.col("x"), F.col("y"), F.col("bz")), cell, (F.col("r"), F.col("g"), F.col("b")))
    packed = c.select("k", "n", row0.alias("row0"), row1.alias("row1"))
    return packed.select("*", *[v.alias(n) for n, v in bits.unpack_onion_sample(F.col("row0"), F.col("row1")).items()])


_MIP = "CASE " + " ".join(f"WHEN abs(x - ({cx!r})) < {h!r} AND abs(y - ({cy!r})) < {h!r} AND abs(z - ({cz!r})) < {h!r} THEN {k}" for k, ((cx, cy, cz), h) in enumerate(zip(CENTRES, HALVES, strict=True))) + " ELSE 16 END"


@query(f"WITH {POINTS} SELECT vec_id, {_MIP} AS mip, CAST(trunc((x - 0.0) * 16.0 + 16.0) AS INT) AS cell FROM pts")
def mip_assign(spark: SparkSession, d: str) -> DataFrame:
    p = tuple(F.col(c) for c in "xyz")
    return adapters.points(spark, d).select("vec_id", geometry.mip_of(p, CENTRES, HALVES).alias("mip"), geometry.quantise(F.col("x"), 16.0).alias("cell"))


@query(f"""WITH {CELLS}, v AS (SELECT * FROM (VALUES (0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0), (1, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0), (2, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0)) t(view_id, fx, fy, fz, rx, ry, rz)),
  p AS (SELECT k, n, n % 3 AS view_id, (x + 0.5) * CAST(0.015625 AS DOUBLE) * 2 - 1 AS sx, (y + 0.5) * CAST(0.015625 AS DOUBLE) * 2 - 1 AS sy, 1.0::DOUBLE / nullif(z * 0.08::DOUBLE + 0.1::DOUBLE, 0) AS depth, r FROM cells),
  q AS (SELECT k, n, view_id, depth, fx + rx * sx - rz * sy AS dx, fy + ry * sx - rx * sy AS dy, fz + rz * sx - ry * sy AS dz, r FROM p JOIN v USING (view_id))
  SELECT k, n, view_id, round(dx * depth + 1, 6) AS px, round(dy * depth + 2, 6) AS py, round(dz * depth + 3, 6) AS pz, CAST(trunc(pow(abs(r / 255.0::DOUBLE), 2.0) * 255 + 0.5) AS INT) AS c,
  round(least(greatest(-1.0::DOUBLE / nullif(dx, 0), 1.0::DOUBLE / nullif(dx, 0)), greatest(-1.0::DOUBLE / nullif(dy, 0), 1.0::DOUBLE / nullif(dy, 0)), greatest(-1.0::DOUBLE / nullif(dz, 0), 1.0::DOUBLE / nullif(dz, 0))), 6) AS sky FROM q""")
def unproject_pixels(spark: SparkSession, d: str) -> DataFrame:
    views = spark.createDataFrame(
        [(0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0), (1, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0), (2, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0)], "view_id int, fx double, fy double, fz double, rx double, ry double, rz double"
    )
    pixels = adapters.cells(spark, d).withColumn("view_id", F.col("n") % 3).join(F.broadcast(views), "view_id")  # three rows
    col = lambda *names: tuple(F.col(n) for n in names)
    ray = geometry.ray(F.col("x"), F.col("y"), F.lit(0.015625), col("fx", "fy", "fz"), col("rx", "ry", "rz"), col("rz", "rx", "ry"))
    pixels = pixels.select("k", "n", "view_id", "r", geometry.linear_depth(F.col("z"), 0.08, 0.1).alias("depth"), *[c.alias(a) for a, c in zip(("dx", "dy", "dz"), ray, strict=True)])
    at = geometry.along((F.lit(1.0), F.lit(2.0), F.lit(3.0)), col("dx", "dy", "dz"), F.col("depth"))
    return pixels.select(
        "k", "n", "view_id", *[F.round(c, 6).alias(a) for a, c in zip(("px", "py", "pz"), at, strict=True)],
        geometry.colour_u8(geometry.gamma(F.col("r") / 255.0, 2.0)).alias("c"), F.round(geometry.sky_exit(col("dx", "dy", "dz"), -1.0, 1.0), 6).alias("sky"),
    )


_ONION = f"""on_ AS (SELECT vec_id, greatest(abs(x), abs(y), abs(z)) AS r, CASE WHEN abs(x) >= abs(y) AND abs(x) >= abs(z) THEN 0 WHEN abs(y) >= abs(z) THEN 1 ELSE 2 END AS axis, x, y, z FROM pts),
  oc AS (SELECT vec_id, axis, CASE axis WHEN 0 THEN x WHEN 1 THEN y ELSE z END AS s, CASE axis WHEN 0 THEN y WHEN 1 THEN z ELSE x END AS u, CASE axis WHEN 0 THEN z WHEN 1 THEN x ELSE y END AS v,
    CAST(floor(log2(r / {ONION.z_min!r}::DOUBLE) * {ONION.period}) AS INT) AS bz FROM on_),
  ocell AS (SELECT vec_id, CASE WHEN s < 0 THEN 1 ELSE 0 END AS sign, axis, CAST(floor((u / (0.01::DOUBLE * pow(2.0, (bz + 1) / 4.0::DOUBLE)) + 1) * 8) AS INT) AS bx, CAST(floor((v / (0.01::DOUBLE * pow(2.0, (bz + 1) / 4.0::DOUBLE)) + 1) * 8) AS INT) AS "by", bz FROM oc)"""


def _onion_cells(spark: SparkSession, d: str) -> DataFrame:
    cell = geometry.onion_cell(ONION, tuple(F.col(c) for c in "xyz"))
    return adapters.points(spark, d).select("vec_id", *[v.alias(n) for n, v in cell.items()])


@query(f"WITH {POINTS}, {_ONION} SELECT *, sign * 4 + axis AS face FROM ocell")
def onion_cell(spark: SparkSession, d: str) -> DataFrame:
    return _onion_cells(spark, d).withColumn("face", bits.face_id(F.col("sign"), F.col("axis")).cast("int"))


@query(f"""WITH {POINTS}, {_ONION}, e AS (SELECT *, 0.01::DOUBLE * pow(2.0, bz / 4.0::DOUBLE) AS near, 0.01::DOUBLE * pow(2.0, (bz + 1) / 4.0::DOUBLE) AS far FROM ocell),
  f AS (SELECT *, (bx * 0.125 - 1) * far AS u0, ((bx + 1) * 0.125 - 1) * far AS u1, ("by" * 0.125 - 1) * far AS v0, (("by" + 1) * 0.125 - 1) * far AS v1, CASE sign WHEN 1 THEN -far ELSE near END AS lo, CASE sign WHEN 1 THEN -near ELSE far END AS hi FROM e)
  SELECT vec_id, round(CASE axis WHEN 0 THEN lo WHEN 1 THEN v0 ELSE u0 END, 6) AS x0, round(CASE axis WHEN 0 THEN u0 WHEN 1 THEN lo ELSE v0 END, 6) AS y0, round(CASE axis WHEN 0 THEN v0 WHEN 1 THEN u0 ELSE lo END, 6) AS z0,
  round(CASE axis WHEN 0 THEN hi WHEN 1 THEN v1 ELSE u1 END, 6) AS x1, round(CASE axis WHEN 0 THEN u1 WHEN 1 THEN hi ELSE v1 END, 6) AS y1, round(CASE axis WHEN 0 THEN v1 WHEN 1 THEN u1 ELSE hi END, 6) AS z1 FROM f""")
def onion_bounds(spark: SparkSession, d: str) -> DataFrame:
    box = geometry.onion_bounds(ONION, *[F.col(c) for c in ("sign", "axis", "bx", "by", "bz")])
    return _onion_cells(spark, d).select("vec_id", *[F.round(v, 6).alias(n) for n, v in box.items()])


# --- hashes, sorting, fits ---------------------------------------------------------------------------------------------


def _hash_sql(v: str) -> str:
    m = 4294967295
    a = f"xor(xor({v}, 61::BIGINT), ({v}) >> 16)"
    return (
        f"(SELECT xor(e, e >> 15) FROM (SELECT (c4 * 668265261) & {m} AS e FROM (SELECT xor(c, c >> 4) AS c4 FROM (SELECT ({a} * 9) & {m} AS c))))"
    )


@query(f"""SELECT p_partkey, {_hash_sql('p_partkey')}::BIGINT AS h32, xor({_hash_sql('p_partkey')}, {_hash_sql('(p_partkey * 7)')})::BIGINT AS h64,
  xor({_hash_sql('p_partkey')} & 65535, {_hash_sql('p_partkey')} >> 16)::BIGINT AS h16, xor(xor({_hash_sql('p_partkey')}, {_hash_sql('p_size::BIGINT')}), {_hash_sql('(p_partkey % 7)')})::BIGINT AS hv, {_hash_sql('p_partkey')}::BIGINT AS hv_compat,
  (SELECT xor(c, (c << 5) & 4294967295) FROM (SELECT xor(b, b >> 17) AS c FROM (SELECT xor(p_partkey, (p_partkey << 13) & 4294967295) AS b)))::BIGINT AS shifted FROM part""")
def hash_u32(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return adapters.table(spark, d, "part").select(
        "p_partkey", hashing.hash_u32(k).alias("h32"), hashing.hash_u64(F.shiftleft(k * 7, 32).bitwiseOR(k)).alias("h64"), hashing.fold_u16(hashing.hash_u32(k)).alias("h16"),
        hashing.hash_vector(k, F.col("p_size"), k % 7, compat=False).alias("hv"), hashing.hash_vector(k, F.col("p_size"), k % 7).alias("hv_compat"), hashing.xorshift(k).alias("shifted"),
    )


def _inverse_sql(base: int, digits: int) -> str:
    return f"list_sum(list_transform(range({digits}), lambda k: ((id + 1) // ({base} ** k)::BIGINT % {base}) / ({base}.0 ** (k + 1))))"


@query(f"SELECT id, round({_inverse_sql(2, 31)}, 6) AS x, round({_inverse_sql(3, 20)}, 6) AS y, round({_inverse_sql(5, 14)}, 6) AS z FROM (SELECT o_orderkey AS id FROM orders)")
def halton(spark: SparkSession, d: str) -> DataFrame:
    return generators.halton_points(adapters.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))).select("id", *[F.round(c, 6).alias(c) for c in "xyz"])


@query(f"WITH {CELLS}, keys AS (SELECT DISTINCT (mip::BIGINT << 15) | ((z % 32) << 10) | ((y % 32) << 5) | (x % 32) AS key FROM cells) SELECT key, row_number() OVER (ORDER BY key) - 1 AS rank FROM keys")
def bitmap_sort_rank(spark: SparkSession, d: str) -> DataFrame:
    c = [F.col(n) % 32 for n in ("x", "y", "z")]
    keys = adapters.cells(spark, d).select(bits.put((F.col("mip"), 15), (c[2], 10), (c[1], 5), (c[0], 0)).alias("key"))
    return sorting.bitmap_ranks(keys, "key")


@query("SELECT p_partkey, p_size, sum(p_size) OVER (ORDER BY p_partkey)::BIGINT AS total FROM part")
def prefix_sum(spark: SparkSession, d: str) -> DataFrame:
    return sorting.running_totals(adapters.table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey", "p_size", 1024)


@query(f"WITH {POINTS} SELECT label, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM pts GROUP BY label")
def bbox(spark: SparkSession, d: str) -> DataFrame:
    return fit.bounding_box(adapters.points(spark, d), "label")


@query(f"""WITH {CELLS}, m AS (SELECT z AS g, avg(x) AS cx, avg(y) AS cy, var_pop(x) AS xx, covar_pop(x, y) AS xy, var_pop(y) AS yy FROM cells GROUP BY z),
  e AS (SELECT *, CASE WHEN xx > yy THEN 1.0 ELSE xy / nullif(yy, 0) END AS dx, CASE WHEN xx > yy THEN xy / nullif(xx, 0) WHEN yy > 0 THEN 1.0 END AS dy FROM m)
  SELECT g, round(cx, 4) AS cx, round(cy, 4) AS cy, round(dx / sqrt(dx * dx + dy * dy), 4) AS dx, round(dy / sqrt(dx * dx + dy * dy), 4) AS dy FROM e""")
def best_fit_line_2d(spark: SparkSession, d: str) -> DataFrame:
    return fit.line_2d(adapters.cells(spark, d).select(F.col("z").alias("g"), "x", "y"), "g")


def _line_3d_sql() -> str:
    steps = ["s0 AS (SELECT *, 0.5773502::DOUBLE AS dx, 0.5773502::DOUBLE AS dy, 0.5773502::DOUBLE AS dz, abs(xy) < 1.1920929e-07 AND abs(xz) < 1.1920929e-07 AND abs(yz) < 1.1920929e-07 AS done FROM m)"]
    for k in range(8):
        steps.append(f"t{k} AS (SELECT *, xx * dx + xy * dy + xz * dz AS a, xy * dx + yy * dy + yz * dz AS b, xz * dx + yz * dy + zz * dz AS c, CASE WHEN sqrt(a * a + b * b + c * c) > 1.1920929e-07 THEN sqrt(a * a + b * b + c * c) ELSE 1 END AS l FROM s{k})")
        steps.append(
            f"s{k + 1} AS (SELECT label, cx, cy, cz, xx, xy, xz, yy, yz, zz, CASE WHEN done THEN dx ELSE a / l END AS dx, CASE WHEN done THEN dy ELSE b / l END AS dy, CASE WHEN done THEN dz ELSE c / l END AS dz, done OR (a * t{k}.dx + b * t{k}.dy + c * t{k}.dz) / l > 0.999999 AS done FROM t{k})"
        )
    moments = "m AS (SELECT label, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, y) AS yy, covar_pop(y, z) AS yz, covar_pop(z, z) AS zz FROM pts GROUP BY label)"
    out = ", ".join([f"round(c{c}, 4) AS c{c}" for c in "xyz"] + [f"round(d{c}, 3) AS d{c}" for c in "xyz"])
    return f"WITH {POINTS}, {moments}, {', '.join(steps)} SELECT label, {out} FROM s8"


@query(_line_3d_sql())
def best_fit_line_3d(spark: SparkSession, d: str) -> DataFrame:
    return fit.line_3d(adapters.points(spark, d), "label")


# --- frames and sequences ----------------------------------------------------------------------------------------------

_RANGES = f"{FRAMES}, isl AS (SELECT *, frame // 7 AS sequence_id, frame - row_number() OVER (PARTITION BY frame // 7, user_id, event_type, n ORDER BY frame) AS i FROM fr), rng AS (SELECT CAST(sequence_id AS INT) AS sequence_id, user_id, event_type, n, min(frame) AS first_frame, max(frame) AS last_frame FROM isl GROUP BY sequence_id, user_id, event_type, n, i)"
KEY = ["user_id", "event_type"]


@query(f"WITH {_RANGES} SELECT * FROM rng")
def delta_ranges(spark: SparkSession, d: str) -> DataFrame:
    return timeline.delta_ranges(adapters.frames(spark, d), KEY, ["n"], RATE)


@query(f"WITH {FRAMES} SELECT CAST(frame // 7 AS INT) AS sequence_id, user_id, event_type, n, frame FROM fr")
def frame_reconstruct(spark: SparkSession, d: str) -> DataFrame:
    return timeline.reconstruct(timeline.delta_ranges(adapters.frames(spark, d), KEY, ["n"], RATE))


@query(f"WITH {FRAMES} SELECT CAST(frame // 7 AS INT) AS sequence_id, user_id, event_type, n, frame FROM fr WHERE frame IN (0, 6, 7, 13, 20)")
def frames_at(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.createDataFrame([(f,) for f in (0, 6, 7, 13, 20)], "frame int")
    return timeline.frame_at(timeline.delta_ranges(adapters.frames(spark, d), KEY, ["n"], RATE), wanted, RATE)


@query("""WITH st AS (SELECT s, CAST(row_number() OVER (ORDER BY s) AS INT) AS sequence_id FROM (SELECT DISTINCT min(event_id) AS s FROM events GROUP BY user_id, CAST(ts AS DATE))),
  fr AS (SELECT DISTINCT event_id AS frame FROM events) SELECT frame, st.sequence_id, frame - s AS frame_rank FROM fr ASOF LEFT JOIN st ON frame >= s""")
def frame_to_sequence(spark: SparkSession, d: str) -> DataFrame:
    """Every event is a frame, the first of each user and day starts a sequence: starts and frames grow with the table."""
    events = adapters.table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("date").alias("day"))
    starts = events.groupBy("user_id", "day").agg(F.min("event_id").alias("start")).select("start", F.lit(1).alias("one")).distinct()
    starts = sorting.running_totals(starts, "start", "one", 1024).select("start", F.col("total").cast("int").alias("sequence_id"))
    return timeline.sequence_lookup(events.select(F.col("event_id").alias("frame")).distinct(), starts)


@query(f"""WITH {FRAMES}, k AS (SELECT DISTINCT frame, user_id, event_type FROM fr), p AS (SELECT coalesce(a.frame, b.frame + 1) AS frame, a.frame IS NOT NULL AS now, b.frame IS NOT NULL AS was
  FROM k a FULL JOIN k b ON a.frame = b.frame + 1 AND a.user_id = b.user_id AND a.event_type = b.event_type) SELECT frame, count(*) FILTER (WHERE now AND NOT was) AS added, count(*) FILTER (WHERE now AND was) AS kept, count(*) FILTER (WHERE was AND NOT now) AS gone FROM p GROUP BY frame""")
def delta_new_kept_gone(spark: SparkSession, d: str) -> DataFrame:
    return timeline.frame_changes(adapters.frames(spark, d), KEY)


_STREAMS = f"{FRAMES}, st AS (SELECT event_type AS stream, CAST(frame // 7 AS INT) AS sequence_id, frame, user_id, n FROM fr)"


def _streams(spark: SparkSession, d: str) -> DataFrame:
    rows = adapters.frames(spark, d)
    return rows.select(F.col("event_type").alias("stream"), timeline.sequence_of(F.col("frame"), RATE).alias("sequence_id"), "frame", "user_id", "n")


@query(f"WITH {_STREAMS}, sz AS (SELECT stream, max(sequence_id) + 1 AS n FROM st GROUP BY stream), off AS (SELECT stream, coalesce(sum(n) OVER (ORDER BY stream ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM sz) SELECT stream, CAST(sequence_id + o AS INT) AS sequence_id, frame, user_id, st.n FROM st JOIN off USING (stream)")
def stream_merge(spark: SparkSession, d: str) -> DataFrame:
    return timeline.merge_streams(_streams(spark, d))


@query(f"WITH {_STREAMS} SELECT stream, CAST(sequence_id - 1 AS INT) AS sequence_id, frame, user_id, n FROM st WHERE sequence_id >= 1 AND sequence_id < (SELECT max(sequence_id) + 1 FROM st) - 1")
def stream_trim(spark: SparkSession, d: str) -> DataFrame:
    return timeline.trim_stream(_streams(spark, d), 1, 1)


@query(f"""WITH {FRAMES}, sq AS (SELECT CAST(frame // 7 AS INT) AS sequence_id, user_id, event_type, n FROM fr), l AS (SELECT * FROM sq WHERE sequence_id < (SELECT max(sequence_id) FROM sq)),
  r AS (SELECT CAST(sequence_id - 1 AS INT) AS sequence_id, user_id, event_type, n FROM sq WHERE sequence_id > (SELECT min(sequence_id) FROM sq)) SELECT *, 'left' AS side FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM r) UNION ALL SELECT *, 'right' FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM l)""")
def stream_validate(spark: SparkSession, d: str) -> DataFrame:
    return timeline.sequence_differences(adapters.frames(spark, d), [*KEY, "n"], RATE)


@query("SELECT event_id, unnest(json_keys(props)) AS key, json_extract_string(props, '$.' || key) AS value FROM events WHERE true UNION ALL SELECT event_id, 'title', event_type FROM events")
def metadata_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = adapters.table(spark, d, "events").select("event_id", timeline.upsert(F.from_json("props", "map<string,string>"), F.lit("title"), F.col("event_type")).alias("meta"))
    return rows.select("event_id", F.explode("meta").alias("key", "value"))


@query("SELECT o_orderkey, CAST(unnest([o_orderkey % 97, o_custkey % 89 + 100]) AS INT) AS frame FROM orders")
def cut_list(spark: SparkSession, d: str) -> DataFrame:
    cuts = F.concat_ws(",", (F.col("o_orderkey") % 97).cast("string"), (F.col("o_custkey") % 89 + 100).cast("string"))
    return adapters.table(spark, d, "orders").select("o_orderkey", F.explode(timeline.cut_frames(cuts)).alias("frame"))


@query(f"WITH {_RANGES} SELECT last_frame - first_frame + 1 AS frames, count(*) AS blocks FROM rng GROUP BY 1")
def unchanged_frames(spark: SparkSession, d: str) -> DataFrame:
    return timeline.unchanged_frames(timeline.delta_ranges(adapters.frames(spark, d), KEY, ["n"], RATE))


@query(f"WITH {FRAMES}, b AS (SELECT frame, user_id, event_type, n::DOUBLE AS x, (user_id % 10)::DOUBLE AS z, frame * 0.5::DOUBLE AS ox, 1.0::DOUBLE AS oz, frame * 0.1::DOUBLE AS yaw FROM fr) SELECT frame, user_id, event_type, round(cos(yaw) * x + sin(yaw) * z + ox, 6) AS wx, round(cos(yaw) * z - sin(yaw) * x + oz, 6) AS wz FROM b")
def frame_basis(spark: SparkSession, d: str) -> DataFrame:
    rows = adapters.frames(spark, d).select("frame", *KEY, F.col("n").cast("double").alias("x"), (F.col("user_id") % 10).cast("double").alias("z"))
    basis = rows.select("frame").distinct().select("frame", (F.col("frame") * 0.5).alias("ox"), F.lit(1.0).alias("oz"), (F.col("frame") * 0.1).alias("yaw"))
    return timeline.at_basis(rows, basis).select("frame", *KEY, F.round("wx", 6).alias("wx"), F.round("wz", 6).alias("wz"))


# --- views -------------------------------------------------------------------------------------------------------------


def _view_sql(k: int, axis: tuple[float, ...]) -> str:
    x, y, z = trace.CORNERS[k]
    return f"(x{x} * {axis[0]!r} + y{y} * {axis[1]!r} + z{z} * {axis[2]!r})"


_SEEN = "seen AS (SELECT block_id, " + ", ".join(f"{_view_sql(k, CAMERA.right)} AS r{k}, {_view_sql(k, CAMERA.up)} AS u{k}, {_view_sql(k, CAMERA.forward)} AS d{k}" for k in range(8)) + " FROM bx)"


def _any(test: str) -> str:
    return "(" + " OR ".join(test.format(k=k) for k in range(8)) + ")"


_IN = " AND ".join(_any(t) for t in ("r{k} <= d{k} * " + repr(CAMERA.tan_x), "-r{k} <= d{k} * " + repr(CAMERA.tan_x), "u{k} <= d{k} * " + repr(CAMERA.tan_y), "-u{k} <= d{k} * " + repr(CAMERA.tan_y)))
_PX = [f"(r{k} / (greatest(d{k}, 0.001) * {CAMERA.tan_x!r}) + 1) * {WIDTH // 2}.0" for k in range(8)]
_PY = [f"(1.0 - u{k} / (greatest(d{k}, 0.001) * {CAMERA.tan_y!r})) * {HEIGHT // 2}.0" for k in range(8)]
_BOUNDS = f"bnd AS (SELECT block_id, least({', '.join(_PX)}) AS min_x, greatest({', '.join(_PX)}) AS max_x, least({', '.join(_PY)}) AS min_y, greatest({', '.join(_PY)}) AS max_y, least({', '.join(f'd{k}' for k in range(8))}) AS depth, list_sort([{', '.join(f"{{'w': d{k}, 'z': (d{k} - 0.001::DOUBLE) * (100.0::DOUBLE / (100.0::DOUBLE - 0.001::DOUBLE))}}" for k in range(8))}])[1].z AS z FROM seen WHERE {_IN})"
_TILES = f"""til AS (SELECT block_id, ty, unnest(range(tx0, tx1 + 1)) AS tx FROM (SELECT *, unnest(range(ty0, ty1 + 1)) AS ty FROM (SELECT block_id, CAST(floor(greatest(0, least(min_x, {WIDTH - 1})) / 8) AS INT) AS tx0, CAST(floor(greatest(0, least(max_x, {WIDTH - 1})) / 8) AS INT) AS tx1,
  CAST(floor(greatest(0, least(min_y, {HEIGHT - 1})) / 8) AS INT) AS ty0, CAST(floor(greatest(0, least(max_y, {HEIGHT - 1})) / 8) AS INT) AS ty1 FROM bnd WHERE max_x >= 0 AND min_x < {WIDTH} AND max_y >= 0 AND min_y < {HEIGHT})))"""
_TO_VIEW = f"{POINTS}, {BOXES}, {_SEEN}"


def _visible(spark: SparkSession, d: str) -> DataFrame:
    return adapters.boxes(spark, d).where(trace.in_frustum(CAMERA))


def _binned(spark: SparkSession, d: str) -> DataFrame:
    return trace.bin_tiles(trace.with_screen_bounds(_visible(spark, d), CAMERA, WIDTH, HEIGHT), WIDTH, HEIGHT, TILE)


@query(f"WITH {_TO_VIEW} SELECT block_id FROM seen WHERE {_IN}")
def frustum_cull(spark: SparkSession, d: str) -> DataFrame:
    return _visible(spark, d).select("block_id")


@query(f"WITH {_TO_VIEW}, {_BOUNDS} SELECT block_id, round(min_x, 4) AS min_x, round(max_x, 4) AS max_x, round(min_y, 4) AS min_y, round(max_y, 4) AS max_y, round(depth, 4) AS depth, round(z, 4) AS z FROM bnd")
def screen_bounds(spark: SparkSession, d: str) -> DataFrame:
    bounds = trace.with_screen_bounds(_visible(spark, d), CAMERA, WIDTH, HEIGHT)
    return bounds.select("block_id", *[F.round(n, 4).alias(n) for n in ("min_x", "max_x", "min_y", "max_y", "depth", "z")])


@query(f"WITH {_TO_VIEW}, {_BOUNDS}, {_TILES} SELECT tx::INT AS tx, ty::INT AS ty, count(*) AS blocks FROM til GROUP BY 1, 2")
def tile_bin(spark: SparkSession, d: str) -> DataFrame:
    return _binned(spark, d).groupBy("tx", "ty").agg(F.count("*").alias("blocks"))


def _rays(spark: SparkSession) -> DataFrame:
    """One ray for each pixel, with its tile."""
    p = spark.range(WIDTH * HEIGHT).select("id", (F.col("id") % WIDTH).cast("int").alias("px"), F.expr(f"cast(id div {WIDTH} as int)").alias("py"))
    sx, sy = (F.col("px") + 0.5) * (2.0 / WIDTH) - 1, (F.col("py") + 0.5) * (2.0 / HEIGHT) - 1
    way = [F.lit(f) + F.lit(r * CAMERA.tan_x) * sx - F.lit(u * CAMERA.tan_y) * sy for f, r, u in zip(CAMERA.forward, CAMERA.right, CAMERA.up, strict=True)]
    return p.select(
        F.col("id").alias("ray_id"), F.expr(f"cast(px div {TILE} as int)").alias("tx"), F.expr(f"cast(py div {TILE} as int)").alias("ty"),
        *[F.lit(o).alias("o" + c) for c, o in zip("xyz", CAMERA.origin, strict=True)], *[w.alias("d" + c) for c, w in zip("xyz", way, strict=True)],
    )


_RAYS = (
    f"ray AS (SELECT id AS ray_id, (id % {WIDTH}) // 8 AS tx, (id // {WIDTH}) // 8 AS ty, "
    + ", ".join(
        f"({f!r}) + ({r * CAMERA.tan_x!r}) * ((id % {WIDTH} + 0.5) * {2.0 / WIDTH!r} - 1) - ({u * CAMERA.tan_y!r}) * ((id // {WIDTH} + 0.5) * {2.0 / HEIGHT!r}::DOUBLE - 1) AS d{c}"
        for c, f, r, u in zip("xyz", CAMERA.forward, CAMERA.right, CAMERA.up, strict=True)
    )
    + f" FROM (SELECT unnest(range({WIDTH * HEIGHT})) AS id))"
)
_SLAB = {f: ", ".join(f"{f}({c}0 / nullif(d{c}, 0), {c}1 / nullif(d{c}, 0))" for c in "xyz") for f in ("least", "greatest")}


@query(f"""WITH {_TO_VIEW}, {_BOUNDS}, {_TILES}, {_RAYS}, hit AS (SELECT ray_id, block_id, round(greatest({_SLAB['least']}), 6) AS t0, round(least({_SLAB['greatest']}), 6) AS t1 FROM ray JOIN til USING (tx, ty) JOIN bx USING (block_id))
  SELECT ray_id, arg_min(block_id, (greatest(t0, 0.0), block_id)) AS block_id, min(greatest(t0, 0.0)) AS t, count(DISTINCT block_id) AS hits FROM hit WHERE t0 <= t1 AND t1 >= 0 GROUP BY ray_id""")
def ray_nearest_hit(spark: SparkSession, d: str) -> DataFrame:
    return trace.nearest_hits(_rays(spark), _binned(spark, d), ["tx", "ty"])


_MATRIX = geometry.matmul([[1, 0, 0, 0.5], [0, 0, -1, 0.25], [0, 1, 0, -2], [0, 0, 0, 1]], [[2, 0, 0, 0], [0, 3, 0, 0], [0, 0, 0.5, 1], [0, 0, 0, 1]])


@query(f"WITH {POINTS} SELECT vec_id, " + ", ".join(f"round({r[0]!r} * x + {r[1]!r} * y + {r[2]!r} * z + {r[3]!r}, 6) AS t{c}" for c, r in zip("xyzw", [[float(v) for v in r] for r in _MATRIX], strict=True)) + " FROM pts")
def transform_points(spark: SparkSession, d: str) -> DataFrame:
    out = geometry.transform(_MATRIX, tuple(F.col(c) for c in "xyz"))
    return adapters.points(spark, d).select("vec_id", *[F.round(v, 6).alias("t" + c) for c, v in zip("xyzw", out, strict=True)])


@query(f"WITH {POINTS}, e AS (SELECT *, sqrt(x * x + y * y + z * z) AS l FROM pts) SELECT vec_id, round(x / l, 6) AS nx, round(0.5 * (0.1 + greatest(0.0, y / l) * 0.3 + greatest(0.0, z / l) * 0.6), 6) AS lit FROM e")
def shade_points(spark: SparkSession, d: str) -> DataFrame:
    n = geometry.normalised(tuple(F.col(c) for c in "xyz"))
    return adapters.points(spark, d).select("vec_id", F.round(n[0], 6).alias("nx"), F.round(color.shade(F.lit(0.5), n[1], n[2]), 6).alias("lit"))


@query(f"WITH {POINTS} SELECT vec_id, round(sqrt(pow(greatest(-0.1 - x, x - 0.1, 0.0), 2) + pow(greatest(-0.05 - y, y - 0.05, 0.0), 2) + pow(greatest(0.0 - z, z - 0.2, 0.0), 2)), 6)::DOUBLE AS gone FROM pts")
def headbox_distance(spark: SparkSession, d: str) -> DataFrame:
    away = geometry.outside_distance(tuple(F.col(c) for c in "xyz"), (-0.1, -0.05, 0.0), (0.1, 0.05, 0.2))
    return adapters.points(spark, d).select("vec_id", F.round(away, 6).alias("gone"))


@query(f"WITH {POINTS} SELECT vec_id, k::INT AS corner, round(x + 0.01 * ({CAMERA.right[0]!r} * (2 * (k & 1) - 1) + {CAMERA.up[0]!r} * ((k & 2) - 1)), 6) AS x, round(y + 0.01 * ({CAMERA.right[1]!r} * (2 * (k & 1) - 1) + {CAMERA.up[1]!r} * ((k & 2) - 1)), 6) AS y, round(greatest(0.0, least(cos(x + y * 2.5), 1.0)), 6)::DOUBLE AS alpha FROM pts, (SELECT unnest(range(4)) AS k)")
def particles(spark: SparkSession, d: str) -> DataFrame:
    p = adapters.points(spark, d)
    corners = geometry.billboard(tuple(F.col(c) for c in "xyz"), F.lit(0.01), CAMERA.right, CAMERA.up)
    rows = p.select("vec_id", scalar.saturate(F.cos(F.col("x") + F.col("y") * 2.5)).alias("alpha"), F.explode(corners).alias("c"))
    return rows.select("vec_id", "c.corner", F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y"), F.round("alpha", 6).alias("alpha"))


@query(f"WITH {POINTS} SELECT vec_id, round(x * 2 + y, 6) AS out, round(CASE label WHEN 0 THEN x WHEN 1 THEN y ELSE z END, 6) AS drawn FROM pts")
def kernel_dispatch(spark: SparkSession, d: str) -> DataFrame:
    p = adapters.points(spark, d).withColumn("drawn", F.round(kernels.by_kind(F.col("label").cast("string"), {"0": F.col("x"), "1": F.col("y")}, F.col("z")), 6))
    return kernels.dispatch(p.select("vec_id", "x", "y", "drawn"), lambda b: b.assign(out=(b["x"] * 2 + b["y"]).round(6))[["vec_id", "out", "drawn"]], "vec_id long, out double, drawn double")


@query(f"WITH {POINTS}, s AS (SELECT label, vec_id // 128 AS part, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)) AS l FROM pts WINDOW w AS (PARTITION BY label, vec_id // 128 ORDER BY vec_id)) SELECT label, part, CAST(count(*) AS INT) AS points, round(coalesce(sum(l), 0), 4) AS length FROM s GROUP BY label, part")
def scene_paths(spark: SparkSession, d: str) -> DataFrame:
    """A path has at most 128 positions, so a label is many paths and no array grows with the table."""
    points = adapters.points(spark, d).withColumn("part", F.expr("vec_id div 128"))
    paths = points.groupBy("label", "part").agg(F.array_sort(F.collect_list(F.struct("vec_id", "x", "y", "z"))).alias("positions"))
    return kernels.path_lengths(paths, ["label", "part"], "positions").withColumn("length", F.round("length", 4))


@query("SELECT CAST(id AS INT) AS view_id, CAST(id // 6 AS INT) AS cubemap, CAST(id % 6 AS INT) AS face FROM (SELECT unnest(range(102)) AS id)")
def viewpoints(spark: SparkSession, d: str) -> DataFrame:
    return generators.viewpoints(spark)


# --- images ------------------------------------------------------------------------------------------------------------


_IDX = "list_position([e0, e1, e2, e3], least(e0, e1, e2, e3)) - 1"


@query(f"""WITH {CELLS}, {IMAGE}, t AS (SELECT *, x // 4 AS tx, y // 4 AS ty FROM img), e AS (SELECT *, min(r) OVER w AS r0, max(r) OVER w AS r1, min(g) OVER w AS g0, max(g) OVER w AS g1, min(b) OVER w AS b0, max(b) OVER w AS b1 FROM t WINDOW w AS (PARTITION BY tx, ty)),
  q AS (SELECT *, {', '.join(f"({' + '.join(f'({c} - ({p.format(c=c)})) * ({c} - ({p.format(c=c)}))' for c in 'rgb')})::BIGINT AS e{k}" for k, p in enumerate(('{c}0', '{c}1', '(2 * {c}0 + {c}1) // 3', '({c}0 + 2 * {c}1) // 3')))} FROM e)
  SELECT CAST(tx AS INT) AS tx, CAST(ty AS INT) AS ty, any_value((r0::BIGINT << 16) | (g0::BIGINT << 8) | b0) AS end0, any_value((r1::BIGINT << 16) | (g1::BIGINT << 8) | b1) AS end1, bit_or(({_IDX})::BIGINT << (2 * (x % 4 + 4 * (y % 4)))) AS indexes, sum(least(e0, e1, e2, e3))::BIGINT AS error, count(*) AS pixels FROM q GROUP BY 1, 2""")
def bc1_block_encode(spark: SparkSession, d: str) -> DataFrame:
    return codec.bc1_blocks(adapters.image(spark, d))


_CODED = f"""lc AS (SELECT x, y, z, CAST(r_sum // cnt AS INT) AS r, CAST(g_sum // cnt AS INT) AS g, CAST(b_sum // cnt AS INT) AS b FROM leaves), lb AS (SELECT *, x >> 2 AS bx, y >> 2 AS "by", z >> 2 AS bz, (x & 3) | ((y & 3) << 2) | ((z & 3) << 4) AS c FROM lc),
  le AS (SELECT *, min(r) OVER w AS r0, max(r) OVER w AS r1, min(g) OVER w AS g0, max(g) OVER w AS g1, min(b) OVER w AS b0, max(b) OVER w AS b1 FROM lb WINDOW w AS (PARTITION BY bx, "by", bz)),
  lq AS (SELECT *, {', '.join(f"({' + '.join(f'({c} - ({p.format(c=c)})) * ({c} - ({p.format(c=c)}))' for c in 'rgb')})::BIGINT AS e{k}" for k, p in enumerate(('{c}0', '{c}1', '(2 * {c}0 + {c}1) // 3', '({c}0 + 2 * {c}1) // 3')))} FROM le)"""


@query(f"""WITH {CELLS}, {LEAVES}, {_CODED} SELECT bx, "by", bz, {', '.join(f"bit_or(CASE WHEN c // 32 = {k} THEN 1::BIGINT << (c % 32) ELSE 0 END) AS presence{k}" for k in range(2))}, {', '.join(f"any_value((r{k}::BIGINT << 16) | (g{k}::BIGINT << 8) | b{k}) AS end{k}" for k in range(2))},
  {', '.join(f"bit_or(CASE WHEN c // 16 = {k} THEN ({_IDX})::BIGINT << (2 * (c % 16)) ELSE 0 END) AS idx{k}" for k in range(4))}, sum(least(e0, e1, e2, e3))::BIGINT AS error, CAST(count(*) AS INT) AS cells FROM lq GROUP BY 1, 2, 3""")
def block_colors(spark: SparkSession, d: str) -> DataFrame:
    return codec.block_colors(voxel.leaf_colors(voxel.leaves(adapters.cells(spark, d))))


@query(f"WITH {CELLS}, {IMAGE} SELECT CAST(x // 2 AS INT) AS x, CAST(y // 2 AS INT) AS y, CAST(sum(r) // count(*) AS INT) AS r, CAST(sum(g) // count(*) AS INT) AS g, CAST(sum(b) // count(*) AS INT) AS b FROM img GROUP BY 1, 2")
def downscale_2x(spark: SparkSession, d: str) -> DataFrame:
    return codec.downscale(adapters.image(spark, d))


def _bc1_sql() -> tuple[str, str]:
    """The CTEs of the encoder, and a pixel's decoded channel."""
    ctes = ORACLES["bc1_block_encode"].rsplit("SELECT CAST(tx AS INT)", 1)[0]
    pick = f"CAST(CASE {_IDX} WHEN 0 THEN {{c}}0 WHEN 1 THEN {{c}}1 WHEN 2 THEN (2 * {{c}}0 + {{c}}1) // 3 ELSE ({{c}}0 + 2 * {{c}}1) // 3 END AS INT) AS {{c}}"
    return ctes, ", ".join(pick.format(c=c) for c in "rgb")


@query(f"{_bc1_sql()[0]} SELECT x, y, {_bc1_sql()[1]} FROM q")
def bc1_block_decode(spark: SparkSession, d: str) -> DataFrame:
    img = adapters.image(spark, d)
    return codec.bc1_pixels(codec.bc1_blocks(img)).join(img.select("x", "y"), ["x", "y"])


@query(f"WITH {CELLS}, {IMAGE}, " + ", ".join(f"i{k} AS (SELECT CAST(x // 2 AS INT) AS x, CAST(y // 2 AS INT) AS y, CAST(sum(r) // count(*) AS INT) AS r, CAST(sum(g) // count(*) AS INT) AS g, CAST(sum(b) // count(*) AS INT) AS b FROM {f'i{k - 1}' if k > 1 else 'img'} GROUP BY 1, 2)" for k in range(1, 5)) + " SELECT 0 AS level, * FROM img" + "".join(f" UNION ALL SELECT {k}, * FROM i{k}" for k in range(1, 5)))
def mip_images(spark: SparkSession, d: str) -> DataFrame:
    return codec.mip_images(adapters.image(spark, d), 5)


@query("WITH w AS (SELECT DISTINCT (p_size * 16)::BIGINT AS width FROM part), l AS (SELECT width, unnest(range(31)) AS k FROM w) SELECT width, CAST(count(*) FILTER (WHERE width >> k >= 4) AS INT) AS mips, sum(8 * (((width >> k) + 3) // 4) * (((width >> k) + 3) // 4)) FILTER (WHERE width >> k >= 4)::BIGINT AS bytes FROM l GROUP BY width")
def mip_chain_size(spark: SparkSession, d: str) -> DataFrame:
    return codec.mip_chain(adapters.table(spark, d, "part").select((F.col("p_size") * 16).cast("long").alias("width")).distinct())


_CROSS = "nb AS (SELECT a.*, " + ", ".join(f"coalesce({s}.{c}, 0) AS {c}_{s}" for s in "lrud" for c in "rgb") + " FROM img a LEFT JOIN img l ON l.x = a.x - 1 AND l.y = a.y LEFT JOIN img r ON r.x = a.x + 1 AND r.y = a.y LEFT JOIN img u ON u.x = a.x AND u.y = a.y - 1 LEFT JOIN img d ON d.x = a.x AND d.y = a.y + 1)"


@query(f"WITH {CELLS}, {IMAGE}, {_CROSS} SELECT x, y, least(r, r_l, r_r, r_u, r_d) AS low, greatest(r, r_l, r_r, r_u, r_d) AS high FROM nb")
def stencil_minmax(spark: SparkSession, d: str) -> DataFrame:
    return image.stencil_range(adapters.image(spark, d), "r")


@query(f"""WITH {CELLS}, {IMAGE}, {_CROSS}, lum AS (SELECT *, (r + 2 * g + b)::DOUBLE AS l0, {', '.join(f'(r_{s} + 2 * g_{s} + b_{s})::DOUBLE AS l{s}' for s in 'lrud')} FROM nb),
  gn AS (SELECT *, CASE WHEN least(l0, ll, lr, lu, ld) > greatest(l0, ll, lr, lu, ld) * 0.5 THEN (l0 * 2 - (ll + lr + lu + ld) * 0.25) / nullif(l0, 0) ELSE 1.0 END AS k FROM lum) SELECT x, y, round(r * k, 6) AS r, round(g * k, 6) AS g, round(b * k, 6) AS b FROM gn""")
def sharpen(spark: SparkSession, d: str) -> DataFrame:
    return image.sharpen(adapters.image(spark, d))


@query(f"""WITH {CELLS}, {IMAGE}, p AS (SELECT x, y, x - 0.25 AS hx, y - 0.5 AS hy FROM img), t AS (SELECT p.x, p.y, CAST(floor(hx) AS INT) + i AS tx, CAST(floor(hy) AS INT) + j AS ty, (CASE i WHEN 1 THEN hx - floor(hx) ELSE 1 - (hx - floor(hx)) END) * (CASE j WHEN 1 THEN hy - floor(hy) ELSE 1 - (hy - floor(hy)) END) AS w
  FROM p, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)) SELECT t.x, t.y, round(sum(coalesce(g, 0) * w), 6)::DOUBLE AS past FROM t LEFT JOIN img ON img.x = tx AND img.y = ty GROUP BY t.x, t.y""")
def history_reproject(spark: SparkSession, d: str) -> DataFrame:
    img = adapters.image(spark, d)
    return image.reproject(img.select("x", "y", F.lit(0.25).alias("dx"), F.lit(-0.5).alias("dy")), img, "g")


@query(f"""WITH {CELLS}, {IMAGE}, a AS (SELECT x, y, r::DOUBLE AS r, g::DOUBLE AS g, b::DOUBLE AS b, r - b AS co, b + (r - b) * 0.5::DOUBLE AS t FROM img), y AS (SELECT *, t + (g - t) * 0.5 AS lum, g - t AS cg FROM a)
  SELECT x, y, lum, co::DOUBLE AS co, cg, (lum - cg * 0.5 - co * 0.5) + co AS r2, cg + (lum - cg * 0.5) AS g2, lum - cg * 0.5 - co * 0.5 AS b2 FROM y""")
def ycocg_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    wide = color.to_ycocg(tuple(F.col(c).cast("double") for c in "rgb"))
    rows = adapters.image(spark, d).select("x", "y", *[v.alias(n) for n, v in zip(("lum", "co", "cg"), wide, strict=True)])
    back = color.from_ycocg(tuple(F.col(n) for n in ("lum", "co", "cg")))
    return rows.select("*", *[v.alias(n) for n, v in zip(("r2", "g2", "b2"), back, strict=True)])


_UV = "uv AS (SELECT x, y, (r + 2 * g + b)::DOUBLE AS lum, r::DOUBLE AS r, (x + 0.5) / 50.0::DOUBLE AS u, (y + 0.5) / 50.0::DOUBLE AS v, (x % 2) * 0.5::DOUBLE AS fade FROM img)"


@query(f"""WITH {CELLS}, {IMAGE}, {_UV}, s AS (SELECT *, greatest(0.0, least((greatest(abs(u * 2 - 1), abs(v * 2 - 1)) - 0.98) * 50.0, 1.0)) AS e FROM uv)
  SELECT x, y, round(e * e * (3.0 - e * 2.0), 6)::DOUBLE AS edge, round(1.0 - sqrt((u * 2 - 1) * (u * 2 - 1) + (v * 2 - 1) * (v * 2 - 1)), 6) AS radial,
  round(CASE WHEN fade = 0 THEN 0.75 * r + 0.25 * CASE WHEN floor(x / 8) % 2 = floor(y / 8) % 2 THEN 0.01 ELSE lum * 0.01 END ELSE (1.0 - fade) * r END, 6) AS shown, CASE WHEN x % 3 = 0 THEN 1.0 WHEN x % 3 = 1 THEN 0.3 WHEN lum / 1020.0 < 0.25 THEN 0.0 ELSE 1.0 END::DOUBLE AS alpha FROM s""")
def post_process(spark: SparkSession, d: str) -> DataFrame:
    rows = adapters.image(spark, d).select(
        "x", "y", color.luminance((F.col("r"), F.col("g"), F.col("b"))).cast("double").alias("lum"), F.col("r").cast("double").alias("r"),
        ((F.col("x") + 0.5) / 50.0).alias("u"), ((F.col("y") + 0.5) / 50.0).alias("v"), (F.col("x") % 2 * 0.5).alias("fade"),
    )
    return rows.select(
        "x", "y", F.round(color.vignette(F.col("u"), F.col("v")), 6).alias("edge"), F.round(color.radial_alpha(F.col("u"), F.col("v")), 6).alias("radial"),
        F.round(color.fade_to_black(F.col("r"), F.col("lum"), F.col("x"), F.col("y"), F.col("fade"), F.lit(0.25)), 6).alias("shown"),
        color.overlay_alpha(F.col("x") % 3, F.lit(0.3), F.col("lum") / 1020.0).alias("alpha"),
    )


@query(f"""WITH RECURSIVE {FRAMES}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY frame) AS i FROM fr), f AS (SELECT user_id, event_type, i, n::DOUBLE AS v FROM o WHERE i = 1
  UNION ALL SELECT o.user_id, o.event_type, o.i, CASE WHEN o.frame % 14 = 0 THEN o.n ELSE f.v + (o.n - f.v) * 0.25 END FROM f JOIN o ON o.user_id = f.user_id AND o.event_type = f.event_type AND o.i = f.i + 1) SELECT user_id, event_type, max(i) AS frames, round(arg_max(v, i), 6) AS value FROM f GROUP BY 1, 2""")
def temporal_blend(spark: SparkSession, d: str) -> DataFrame:
    rows = adapters.frames(spark, d).select("frame", *KEY, F.col("n").cast("double").alias("n"), (F.col("frame") % 14 == 0).alias("cut"))
    return image.blend_over_time(rows, KEY, "n", 0.25)


def _moved_sql(k: int, channels: tuple[str, ...], ox: float, oy: float) -> list[str]:
    """``o{k}``: a frame as it is; ``c{k}``: with colours taken off the centres of pixels, and places in the history."""
    own = f"o{k} AS (SELECT *, x - dx AS hx, y + dy AS hy FROM yc WHERE frame = {k})"
    if not ox and not oy:
        return [own, f"c{k} AS (SELECT * FROM o{k})"]
    held = f"greatest(least(x + ({ox!r}::DOUBLE), 63.0::DOUBLE), 0.0::DOUBLE) AS px, greatest(least(y + ({oy!r}::DOUBLE), 63.0::DOUBLE), 0.0::DOUBLE) AS py"
    weight = "(CASE i WHEN 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END) * (CASE j WHEN 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END)"
    taps = f"(SELECT m.x, m.y, CAST(floor(px) AS INT) + i AS tx, CAST(floor(py) AS INT) + j AS ty, {weight} AS w FROM (SELECT x, y, {held} FROM o{k}) m, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j))"
    sums = ", ".join(f"sum(coalesce(s.{c}, 0) * w) AS {c}" for c in (*channels, "a"))
    return [own, f"j{k} AS (SELECT t.x, t.y, {sums} FROM {taps} t LEFT JOIN o{k} s ON s.x = tx AND s.y = ty GROUP BY t.x, t.y)", f"c{k} AS (SELECT o.x, o.y, o.dx, o.dy, o.hx, o.hy, {', '.join(f'j.{c}' for c in (*channels, 'a'))} FROM o{k} o JOIN j{k} j USING (x, y))"]


def _resolve_sql(frames: int, offsets: dict[int, tuple[float, float]] | None = None, source: str = "mov", nudge: str = "") -> str:
    """A step for each frame but the first; supplied tables have ``frames`` line numbers.  ``offsets``: how far the sample of a
    frame's pixels is from their centres."""
    offsets = offsets or {}
    channels = ("lum", "co", "cg")
    ctes = ["""places AS (SELECT CAST(i % 64 AS INT) AS x, CAST(i // 64 AS INT) AS y FROM (SELECT unnest(range(4096)) AS i))""",
        """found AS (SELECT n AS frame, x, y, sum(r) // count(*) AS r, sum(g) // count(*) AS g, sum(b) // count(*) AS b FROM cells GROUP BY n, x, y)""",
        """mov AS (SELECT f.frame, x, y, coalesce(r, 0)::DOUBLE AS r, coalesce(g, 0)::DOUBLE AS g, coalesce(b, 0)::DOUBLE AS b, ((x + f.frame) % 5 - 2) * 0.4::DOUBLE AS dx, ((y + f.frame * 2) % 5 - 2) * 0.3::DOUBLE AS dy,
  CASE WHEN (x + y + f.frame) % 7 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS a FROM (SELECT DISTINCT n AS frame FROM cells) f CROSS JOIN places LEFT JOIN found USING (frame, x, y))""",
        """yc AS (SELECT frame, x, y, dx, dy, a, t + (g - t) * 0.5::DOUBLE AS lum, r - b AS co, g - t AS cg FROM (SELECT *, b + (r - b) * 0.5::DOUBLE AS t FROM """ + source + "))",
        "h1 AS (SELECT x, y, lum, co, cg, a FROM yc WHERE frame = 1)"]
    for k in range(2, frames + 1):
        ends = ", ".join(f"{f}(c.{c}, " + ", ".join(f"coalesce({s}.{c}, 0)" for s in "lrud") + f") AS {c}{e}" for c in channels for e, f in ((0, "least"), (1, "greatest")))
        joins = " ".join(f"LEFT JOIN o{k} {s} ON {s}.x = c.x {i} AND {s}.y = c.y {j}" for s, i, j in (("l", "- 1", ""), ("r", "+ 1", ""), ("u", "", "- 1"), ("d", "", "+ 1")))
        past = ", ".join(f"sum(coalesce(h.{c}, 0) * w) AS {c}_p" for c in (*channels, "a"))
        pull = ", ".join(f"{c}_p + (greatest(least({c}_p, {c}1), {c}0) - {c}_p) * least(sqrt(dx * dx + dy * dy) * 0.5::DOUBLE, 1.0::DOUBLE) AS {c}_q" for c in channels)
        ctes += [
            *_moved_sql(k, channels, *offsets.get(k, (0.0, 0.0))),
            f"n{k} AS (SELECT c.*, {ends} FROM c{k} c {joins})",
            f"t{k} AS (SELECT x, y, CAST(floor(hx) AS INT) + i AS tx, CAST(floor(hy) AS INT) + j AS ty, (CASE i WHEN 1 THEN hx - floor(hx) ELSE 1 - (hx - floor(hx)) END) * (CASE j WHEN 1 THEN hy - floor(hy) ELSE 1 - (hy - floor(hy)) END) AS w FROM c{k}, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j))",
            f"p{k} AS (SELECT t.x, t.y, {past} FROM t{k} t LEFT JOIN h{k - 1} h ON h.x = tx AND h.y = ty GROUP BY t.x, t.y)",
            f"q{k} AS (SELECT *, {pull}, CASE WHEN hx < -0.5 OR hx > 63.5 OR hy < -0.5 OR hy > 63.5 OR a_p > 0 OR a > 0 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS w FROM n{k} JOIN p{k} USING (x, y))",
            f"h{k} AS (SELECT x, y, {', '.join(f'{c}_q + ({c} - {c}_q) * w AS {c}' for c in channels)}, CASE WHEN a > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS a FROM q{k})",
        ]
    back = "lum - cg * 0.5::DOUBLE - co * 0.5::DOUBLE"
    return f"WITH {CELLS}, {', '.join(ctes)} SELECT x, y, round({back} + co{nudge}, 6) + 0.0::DOUBLE AS r, round(cg + (lum - cg * 0.5::DOUBLE){nudge}, 6) + 0.0::DOUBLE AS g, round({back}{nudge}, 6) + 0.0::DOUBLE AS b, a FROM h{frames}"


@query(_resolve_sql(7))
def temporal_resolve(spark: SparkSession, d: str) -> DataFrame:
    return image.temporal_resolve(adapters.moving_images(spark, d), 0.25, 64, 64)


@query(f"WITH {CELLS}, {IMAGE} SELECT x, y, r, g, b FROM img UNION ALL SELECT x + 64, y, b, g, r FROM img")
def side_by_side(spark: SparkSession, d: str) -> DataFrame:
    img = adapters.image(spark, d)
    return image.side_by_side(img, img.select("x", "y", F.col("b").alias("r"), "g", F.col("r").alias("b")), 64)


# --- metrics -----------------------------------------------------------------------------------------------------------


@query(f"WITH {DRAWS}, e AS (SELECT frame_id, user_id, events, xor(events, lag(events, 1, 0) OVER (PARTITION BY user_id ORDER BY frame_id)) AS changed FROM dr) SELECT frame_id, changed, changed & events AS pressed, changed & ~events AS released FROM e")
def event_edges(spark: SparkSession, d: str) -> DataFrame:
    return metrics.edges(adapters.draw_times(spark, d), "user_id", "frame_id", "events").select("frame_id", "changed", "pressed", "released")


@query(f"WITH {DRAWS} SELECT user_id, frame_id, CAST(frame_id % 4140 AS INT) AS slot, min(draw_us) OVER w AS low, round(avg(draw_us) OVER w, 4) AS mid, max(draw_us) OVER w AS high FROM dr WINDOW w AS (PARTITION BY user_id ORDER BY frame_id ROWS BETWEEN 4139 PRECEDING AND CURRENT ROW)")
def frame_metrics_window(spark: SparkSession, d: str) -> DataFrame:
    return metrics.ring_markers(adapters.draw_times(spark, d), "user_id")


@query(f"WITH {DRAWS} SELECT user_id, count(*) AS hitches, max(draw_us) AS worst_us FROM dr WHERE draw_us >= 10000 GROUP BY user_id")
def hitches(spark: SparkSession, d: str) -> DataFrame:
    return metrics.hitches(adapters.draw_times(spark, d), "user_id", 10000)


@query(f"WITH {DRAWS} SELECT user_id, count(*) AS calls, round(avg(draw_us), 4) AS mean_us FROM dr GROUP BY user_id")
def event_durations(spark: SparkSession, d: str) -> DataFrame:
    return metrics.durations(adapters.draw_times(spark, d), "user_id")


@query(f"WITH {DRAWS}, t AS (SELECT *, least(draw_us * 0.01, 99.0)::DOUBLE AS t, frame_id % 100 AS y FROM dr) SELECT frame_id, (events & 5) <> 0 AND y >= 20 AND y <= 60 AS shown, round(greatest(0.0, least(t - y, 1.0)) * 0.25, 6)::DOUBLE AS plot, round(CASE WHEN y > 0 THEN (1.0 - greatest(0.0, least(y::DOUBLE % 10.0::DOUBLE, 1.0))) * 0.25 ELSE 0 END, 6)::DOUBLE AS grid FROM t")
def frame_plot(spark: SparkSession, d: str) -> DataFrame:
    rows = adapters.draw_times(spark, d).withColumn("y", F.col("frame_id") % 100)
    return rows.select(
        "frame_id", metrics.has_event(F.col("events"), 5, F.col("y"), 20, 60).alias("shown"), F.round(color.plot_fade(F.col("draw_us"), F.col("y"), 0.01, 100), 6).alias("plot"), F.round(color.grid_fade(F.col("y"), 1000.0, 0.01), 6).alias("grid")
    )


# --- scenes and text ---------------------------------------------------------------------------------------------------


@query("SELECT c_custkey AS entity_id, c_mktsegment AS material, n_name AS mesh, r_name AS area FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal >= 0")
def scene_join(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: adapters.table(spark, d, n)
    entities = t("customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_mktsegment").alias("material"), F.col("c_nationkey").alias("mesh_id"), (F.col("c_acctbal") >= 0).alias("visible"))
    meshes = t("nation").select(F.col("n_nationkey").alias("mesh_id"), F.col("n_name").alias("mesh"), F.col("n_regionkey").alias("material_id"))
    areas = t("region").select(F.col("r_regionkey").alias("material_id"), F.col("r_name").alias("area"))
    entities = entities.join(meshes.select("mesh_id", "material_id"), "mesh_id")
    return scene.scene(entities, areas, meshes.drop("material_id")).select("entity_id", "material", "mesh", "area")


@query("WITH q AS (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN 'unknown' ELSE '' END AS name FROM customer), i AS (SELECT c_mktsegment AS name, min(c_custkey) AS id FROM customer GROUP BY 1) SELECT k, q.name, coalesce(id, 4294967295)::BIGINT AS entity_id FROM q LEFT JOIN i ON i.name = q.name")
def entity_lookup(spark: SparkSession, d: str) -> DataFrame:
    c = adapters.table(spark, d, "customer")
    names = c.select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).when(F.col("c_custkey") % 3 == 1, "unknown").otherwise("").alias("name"))
    return scene.lookup(names, c.select(F.col("c_custkey").alias("entity_id"), F.col("c_mktsegment").alias("name"))).select("k", "name", "entity_id")


@query("""WITH l AS (SELECT p_partkey, p_name FROM part), c AS (SELECT p_partkey, unnest(string_split(p_name, '')) AS ch, generate_subscripts(string_split(p_name, ''), 1) - 1 AS pos FROM l), a AS (SELECT *, CASE WHEN ch BETWEEN 'a' AND 'z' THEN ascii(ch) % 7 + 3 ELSE 0 END AS adv FROM c WHERE ch <> '')
  SELECT p_partkey, CAST(pos AS INT) AS at, ch, coalesce(sum(adv) OVER (PARTITION BY p_partkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pen FROM a""".replace("AS at", 'AS "at"'))
def glyph_layout(spark: SparkSession, d: str) -> DataFrame:
    glyphs = spark.range(26).select(F.chr(F.col("id") + 97).alias("ch"), ((F.col("id") + 97) % 7 + 3).alias("advance"))
    return text.glyph_layout(adapters.table(spark, d, "part"), glyphs, "p_partkey", "p_name")


@query("SELECT p_partkey, 'id' AS key, p_partkey::VARCHAR AS value FROM part UNION ALL SELECT p_partkey, 'size', p_size::VARCHAR FROM part UNION ALL SELECT p_partkey, 'char', NULL FROM part")
def kv_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = adapters.table(spark, d, "part").select("p_partkey", F.format_string("char id=%d   size=%d", "p_partkey", "p_size").alias("line"))
    return rows.select("p_partkey", F.explode(text.key_values(F.col("line"))).alias("key", "value"))


@query("""WITH h AS (SELECT p_partkey, hex(p_name) AS h, unnest(range(greatest((strlen(p_name) + 15) // 16, 1))) AS row FROM part) SELECT p_partkey, CAST(row AS INT) AS row, CASE WHEN h = '' THEN '' ELSE rtrim(regexp_replace(substr(h, CAST(row * 32 + 1 AS BIGINT), 32), '(..)', '0x\\1, ', 'g'), ', ') END AS line FROM h""")
def hex_rows(spark: SparkSession, d: str) -> DataFrame:
    return text.hex_rows(adapters.table(spark, d, "part").select("p_partkey", F.col("p_name").cast("binary").alias("b")), "p_partkey", "b")


@query("SELECT o_orderkey, regexp_replace(reverse(regexp_replace(reverse((o_orderkey * 1000)::VARCHAR), '(\\d{3})', '\\1,', 'g')), '^,', '') AS digits, o_orderkey // 1024 AS kb, (o_orderkey + 15) // 16 AS groups, o_orderkey & (o_orderkey - 1) = 0 AS power, CASE WHEN o_orderkey = 0 THEN -1 ELSE CAST(floor(log2(nullif(o_orderkey, 0))) AS INT) END AS high, round(o_orderkey * (3.1415926 / 180.0)::DOUBLE, 6) AS rad FROM orders")
def number_formats(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return adapters.table(spark, d, "orders").select(
        "o_orderkey", scalar.thousands(k * 1000).alias("digits"), scalar.in_unit(k, "KB").alias("kb"), bits.group_count(k, 16).alias("groups"), bits.is_power_of_two(k).alias("power"), bits.highest_bit(k).alias("high"), F.round(scalar.radians(k), 6).alias("rad")
    )


@query("SELECT page_id, regexp_extract(url, '([^/\\\\]*)$', 1) AS name, regexp_extract(url, '^(.*)[/\\\\][^/\\\\]*$', 1) AS folder, regexp_extract(url, '\\.([^./\\\\]*)$', 1) AS ext, regexp_replace(url, '\\.[^./\\\\]*$', '') || '.bc1' AS other FROM pages")
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return adapters.table(spark, d, "pages").select("page_id", scalar.file_name(u).alias("name"), scalar.file_folder(u).alias("folder"), scalar.file_extension(u).alias("ext"), scalar.with_extension(u, "bc1").alias("other"))


_EDGE_ROWS = ", ".join(f"({2 * k + e + 1}, {v & 1}, {v >> 1 & 1}, {v >> 2 & 1})" for k, edge in enumerate(text.BOX_EDGES) for e, v in enumerate(edge))


@query(f"WITH {POINTS}, {BOXES} SELECT block_id * 24 + n AS vertex_id, printf('v %.4f %.4f %.4f', CASE i WHEN 1 THEN x1 ELSE x0 END, CASE j WHEN 1 THEN y1 ELSE y0 END, CASE k WHEN 1 THEN z1 ELSE z0 END) AS line FROM bx, (VALUES {_EDGE_ROWS}) t(n, i, j, k)")
def box_wireframes(spark: SparkSession, d: str) -> DataFrame:
    return text.obj_vertices(text.box_wireframes(adapters.boxes(spark, d), "block_id"))


# --- streams -----------------------------------------------------------------------------------------------------------


@query("SELECT date_trunc('day', CAST(ts AS TIMESTAMP)) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_sequence_counts(spark: SparkSession, d: str) -> DataFrame:
    return sequences.run_to_end(sequences.sequence_counts(sequences.read_events(spark, f"{d}/events.parquet")), "complete")


@query("""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), f AS (SELECT user_id, i, value::DOUBLE AS v FROM o WHERE i = 1
  UNION ALL SELECT o.user_id, o.i, f.v + (o.value - f.v) * 0.25::DOUBLE FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1) SELECT user_id, max(i) AS seen, round(arg_max(v, i), 6) AS value FROM f GROUP BY user_id""")
def stream_temporal_blend(spark: SparkSession, d: str) -> DataFrame:
    """What each user's history is after the last batch, however the table was dealt into batches."""
    rows = sequences.run_to_end(sequences.blend_history(sequences.read_events(spark, f"{d}/events.parquet"), 0.25), "update")
    return rows.groupBy("user_id").agg(F.max(F.struct("seen", "value")).alias("v")).select("user_id", "v.*")
