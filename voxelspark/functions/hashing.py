"""Integer hashes and sequences on BIGINT columns that hold unsigned 32-bit values."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bits import U32, u32

#: Fixed values of the published integer hash (Wang) and of Marsaglia's xorshift.
WANG = {"seed": 61, "first_shift": 16, "factor": 9, "second_shift": 4, "multiplier": 0x27D4EB2D, "third_shift": 15}
XORSHIFT = (13, 17, 5)


def hash_u32(v: Column) -> Column:
    s = u32(v.cast("long"))
    s = s.bitwiseXOR(F.lit(WANG["seed"])).bitwiseXOR(F.shiftright(s, WANG["first_shift"]))
    s = u32(s * WANG["factor"])
    s = s.bitwiseXOR(F.shiftright(s, WANG["second_shift"]))
    s = u32(s * WANG["multiplier"])
    return s.bitwiseXOR(F.shiftright(s, WANG["third_shift"]))


def hash_u64(v: Column) -> Column:
    """Hashes of both halves, xored; equal halves give 0."""
    return hash_u32(u32(v)).bitwiseXOR(hash_u32(F.shiftrightunsigned(v, 32)))


def fold_u16(h: Column) -> Column:
    return h.bitwiseAND(F.lit(0xFFFF)).bitwiseXOR(F.shiftright(h, 16))


def hash_vector(x: Column, y: Column, z: Column, compat: bool = True) -> Column:
    """``compat`` leaves z out and takes y twice, as streams of the old kind expect; else all three count."""
    hx, hy = hash_u32(x), hash_u32(y)
    return hx if compat else hx.bitwiseXOR(hy).bitwiseXOR(hash_u32(z))


def xorshift(v: Column) -> Column:
    a, b, c = XORSHIFT
    s = u32(v.cast("long"))
    s = s.bitwiseXOR(u32(F.shiftleft(s, a)))
    s = s.bitwiseXOR(F.shiftright(s, b))
    return s.bitwiseXOR(u32(F.shiftleft(s, c)))


def halton(index: Column, base: int) -> Column:
    """Radical inverse of ``index`` + 1 for indexes below 2^31."""
    digits = math.ceil(31 / math.log2(base))
    i = (index + 1).cast("long")
    terms = [(F.floor(i / F.lit(float(base**k))).cast("long") % base) / F.lit(float(base ** (k + 1))) for k in range(digits)]
    return sum(terms[1:], terms[0])


def sphere(u: Column, v: Column) -> tuple[Column, Column, Column]:
    """A uniform direction from two uniform numbers."""
    alpha, z = u * (2 * math.pi), v * 2 - 1
    r = F.sqrt(1 - z * z)
    return r * F.cos(alpha), r * F.sin(alpha), z


__all__ = ["U32", "fold_u16", "halton", "hash_u32", "hash_u64", "hash_vector", "sphere", "xorshift"]
