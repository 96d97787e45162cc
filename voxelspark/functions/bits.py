"""Unsigned 32-bit values in BIGINT columns: packing, addresses, masks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

U32 = 0xFFFFFFFF


def long(c: Column) -> Column:
    return c.cast("long")


def u32(c: Column) -> Column:
    return c.bitwiseAND(F.lit(U32))


def put(*fields: tuple[Column, int]) -> Column:
    """Fields shifted to their places and joined; each must fit its place."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(long(c), s) if s else long(c) for c, s in fields])


def get(word: Column, shift: int, width: int) -> Column:
    """``width`` bits of a word from ``shift`` up."""
    return F.shiftright(word, shift).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def pack_mip_sample(x: Column, y: Column, z: Column, mip: Column, r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    """Two words: x 12 bits, y 12, r 8; z 12, g 8, b 8, mip 4."""
    return put((x, 20), (y, 8), (r, 0)), put((z, 20), (g, 12), (b, 4), (mip, 0))


def unpack_mip_sample(row0: Column, row1: Column) -> dict[str, Column]:
    return {
        "x": get(row0, 20, 12), "y": get(row0, 8, 12), "z": get(row1, 20, 12), "mip": get(row1, 0, 4),
        "r": get(row0, 0, 8), "g": get(row1, 12, 8), "b": get(row1, 4, 8),
    }


def pack_onion_sample(sign: Column, axis: Column, block: tuple[Column, ...], cell: tuple[Column, ...], rgb: tuple[Column, ...]) -> tuple[Column, Column]:
    """Two words: sign 1 bit, axis 2, block 9 + 9 + 11; colour 8 + 8 + 8, cell 2 + 2 + 2."""
    row0 = put((sign, 31), (axis, 29), (block[0], 20), (block[1], 11), (block[2], 0))
    return row0, put((rgb[0], 24), (rgb[1], 16), (rgb[2], 8), (cell[0], 4), (cell[1], 2), (cell[2], 0))


def unpack_onion_sample(row0: Column, row1: Column) -> dict[str, Column]:
    return {
        "sign": get(row0, 31, 1), "axis": get(row0, 29, 2), "bx": get(row0, 20, 9), "by": get(row0, 11, 9), "bz": get(row0, 0, 11),
        "r": get(row1, 24, 8), "g": get(row1, 16, 8), "b": get(row1, 8, 8), "cx": get(row1, 4, 2), "cy": get(row1, 2, 2), "cz": get(row1, 0, 2),
    }


def mip_block_address(mip: Column, bx: Column, by: Column, bz: Column) -> Column:
    return put((mip, 28), (bx, 18), (by, 9), (bz, 0))


def onion_block_address(face: Column, bx: Column, by: Column, bz: Column) -> Column:
    return put((face, 29), (bx, 20), (by, 11), (bz, 0))


def face_id(sign: Column, axis: Column) -> Column:
    return put((sign, 2), (axis, 0))


def morton(x: Column, y: Column, z: Column, levels: int) -> Column:
    """The low ``levels`` bits of three coordinates interleaved, x lowest: 3 bits for each level, 63 at most."""
    terms = [F.shiftleft(F.shiftright(v.cast("long"), k).bitwiseAND(F.lit(1)), 3 * k + a) for k in range(levels) for a, v in enumerate((x, y, z))]
    return reduce(lambda a, b: a.bitwiseOR(b), terms, F.lit(0).cast("long"))


def octant(x: Column, y: Column, z: Column) -> Column:
    """Morton order inside a parent, x lowest."""
    one = F.lit(1)
    return put((z.bitwiseAND(one), 2), (y.bitwiseAND(one), 1), (x.bitwiseAND(one), 0)).cast("int")


def single_bit(k: Column) -> Column:
    """The integer that has bit ``k`` alone."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int"))


def popcount(c: Column) -> Column:
    return F.bit_count(c).cast("int")


def highest_bit(c: Column) -> Column:
    """Index of the highest set bit; -1 for 0."""
    return F.when(c == 0, -1).otherwise(F.length(F.bin(c)) - 1).cast("int")


def is_power_of_two(c: Column) -> Column:
    """True for 0 as well."""
    return c.bitwiseAND(c - 1) == 0


def round_up(c: Column, alignment: int) -> Column:
    """The least multiple of ``alignment``, a power of two, that is not below the value."""
    if alignment <= 0 or alignment & (alignment - 1):
        raise ValueError(f"{alignment} is not a power of two")
    return (long(c) + (alignment - 1)).bitwiseAND(F.lit(-alignment))


def group_count(count: Column, size: int) -> Column:
    """Groups of ``size`` that hold ``count``, by whole numbers."""
    return F.call_function("div", long(count) + (size - 1), F.lit(size))


def unpack_character(position: Column, rectangle: Column, rgba: Column) -> dict[str, Column]:
    """A character's place (16 + 16 bits), its rectangle in the font's image (8 bits each) and its colour (0 to 1)."""
    fields = {"px": get(position, 16, 16), "py": get(position, 0, 16)}
    fields |= {n: get(rectangle, s, 8) for n, s in (("x", 24), ("y", 16), ("w", 8), ("h", 0))}
    return fields | {n: get(rgba, s, 8) / F.lit(255.0) for n, s in (("r", 24), ("g", 16), ("b", 8), ("a", 0))}


def both_masks(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, ...]:
    """Cells that both blocks have; a block is a tuple of masks."""
    return tuple(x.bitwiseAND(y) for x, y in zip(a, b, strict=True))


def either_mask(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, ...]:
    """Cells that one block has or the other."""
    return tuple(x.bitwiseOR(y) for x, y in zip(a, b, strict=True))


def mask_without(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, ...]:
    """Cells that the first block has and the second has not."""
    return tuple(x.bitwiseAND(F.bitwise_not(y)) for x, y in zip(a, b, strict=True))


def mask_size(masks: tuple[Column, ...]) -> Column:
    return reduce(lambda a, b: a + b, [popcount(m) for m in masks])


def range_mask(width: int, offset: int) -> int:
    return ((1 << width) - 1) << offset
