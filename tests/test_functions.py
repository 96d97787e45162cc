"""Row-wise functions against plain arithmetic, and identities."""

import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxelspark.functions import bits, color, geometry, hashing, scalar

U32 = 0xFFFFFFFF


def wang(s):
    s = (s ^ 61) ^ (s >> 16)
    s = s * 9 & U32
    s ^= s >> 4
    s = s * 0x27D4EB2D & U32
    return s ^ (s >> 15)


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


@settings(max_examples=8, deadline=None)
@given(st.integers(0, U32), st.integers(0, U32))
def test_hashes(spark, a, b):
    c = F.lit(a).cast("long")
    x = a
    for shift in (13, -17, 5):
        x ^= (x << shift & U32) if shift > 0 else x >> -shift
    wide = (b << 32 | a) - (1 << 64 if b >> 31 else 0)
    got = one(spark, h=hashing.hash_u32(c), x=hashing.xorshift(c), w=hashing.hash_u64(F.lit(wide).cast("long")))
    assert got == {"h": wang(a), "x": x, "w": wang(a) ^ wang(b)}


@settings(max_examples=8, deadline=None)
@given(st.tuples(*[st.integers(0, 4095)] * 3), st.integers(0, 15), st.tuples(*[st.integers(0, 255)] * 3))
def test_samples_unpack_as_packed(spark, p, mip, rgb):
    row0, row1 = bits.pack_mip_sample(*[F.lit(v) for v in (*p, mip, *rgb)])
    df = spark.range(1).select(row0.alias("row0"), row1.alias("row1"))
    got = df.select(*[v.alias(n) for n, v in bits.unpack_mip_sample(F.col("row0"), F.col("row1")).items()]).first()
    assert tuple(got) == (*p, mip, *rgb)


def test_bits(spark):
    got = one(
        spark, zero=bits.is_power_of_two(F.lit(0)), high=bits.highest_bit(F.lit(0)), up=bits.round_up(F.lit(33), 16), same=bits.round_up(F.lit(64), 64), n=bits.group_count(F.lit(17), 8),
        ones=bits.popcount(F.lit(255)),
    )
    assert got == {"zero": True, "high": -1, "up": 48, "same": 64, "n": 3, "ones": 8}
    assert bits.range_mask(3, 4) == 0b1110000


def test_halton(spark):
    got = [round(r[0], 6) for r in spark.range(5).select(hashing.halton(F.col("id"), 2)).collect()]
    assert got == [0.5, 0.25, 0.75, 0.125, 0.625]


def test_onion_cell_holds_its_point(spark):
    o = geometry.Onion()
    rng = random.Random(3)
    points = spark.createDataFrame([tuple(rng.uniform(-1, 1) for _ in "xyz") for _ in range(300)], "x double, y double, z double").repartition(2)
    rows = points.select("*", *[v.alias(n) for n, v in geometry.onion_cell(o, tuple(F.col(c) for c in "xyz")).items()])
    box = geometry.onion_bounds(o, *[F.col(c) for c in ("sign", "axis", "bx", "by", "bz")])
    rows = rows.select("x", "y", "z", *[v.alias(n) for n, v in box.items()])
    assert rows.where(" or ".join(f"{c} < {c}0 - 1e-9 or {c} > {c}1 + 1e-9" for c in "xyz")).count() == 0


def test_camera_basis_is_orthonormal():
    c = geometry.Camera.looking((0, 0, 0), 0.7, -0.3, 1.0, 1.0)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a, b, want in ((c.forward, c.forward, 1), (c.right, c.right, 1), (c.up, c.up, 1), (c.forward, c.right, 0), (c.right, c.up, 0), (c.up, c.forward, 0)):
        assert math.isclose(dot(a, b), want, abs_tol=1e-9)
    left, right = c.eyes(0.06)
    assert math.isclose(math.dist(left.origin, right.origin), 0.06)


def test_division_by_zero_is_null(spark):
    got = one(spark, d=geometry.linear_depth(F.lit(0.0), 1.0, 0.0), n=geometry.normalised((F.lit(0.0), F.lit(0.0), F.lit(0.0)))[0])
    assert got == {"d": None, "n": 0.0}


def test_colours_and_scalars(spark):
    rgb = tuple(F.lit(v) for v in (0.2, 0.4, 0.9))
    back = color.from_ycocg(color.to_ycocg(rgb))
    got = one(spark, r=F.round(back[0], 9), g=F.round(back[1], 9), b=F.round(back[2], 9), c=scalar.clamp(F.lit(3.0), 0.0, 1.0), t=scalar.thousands(F.lit(2000500)), e=color.vignette(F.lit(0.5), F.lit(1.0)))
    assert got == {"r": 0.2, "g": 0.4, "b": 0.9, "c": 1.0, "t": "2,000,500", "e": 1.0}
