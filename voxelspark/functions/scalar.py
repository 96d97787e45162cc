"""Scalar helpers: ranges, angles, sizes, numbers and paths as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed single-precision value of pi.
PI = 3.1415926


def clamp(v: Column, lo: float | Column, hi: float | Column) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.greatest(as_column(lo), F.least(v, as_column(hi)))


def saturate(v: Column) -> Column:
    return clamp(v, 0.0, 1.0)


def lerp(a: Column, b: Column, t: Column) -> Column:
    return (F.lit(1.0) - t) * a + t * b


def smoothstep(x: Column) -> Column:
    return x * x * (F.lit(3.0) - x * 2.0)


def radians(deg: Column) -> Column:
    return deg * (PI / 180.0)


def degrees(rad: Column) -> Column:
    return rad * (180.0 / PI)


#: Powers of two of the units of sizes.
UNITS = {"KB": 10, "MB": 20, "GB": 30}


def from_unit(n: Column, unit: str) -> Column:
    """Bytes of so many KB, MB or GB."""
    return F.shiftleft(n.cast("long"), UNITS[unit])


def in_unit(n: Column, unit: str) -> Column:
    """Whole KB, MB or GB of so many bytes."""
    return F.shiftright(n.cast("long"), UNITS[unit])


def ansi(text: Column) -> Column:
    """One byte for each character; a question mark for those that ISO 8859-1 has not."""
    return F.encode(F.regexp_replace(text, "[^\\x00-\\xFF]", "?"), "ISO-8859-1")


def thousands(n: Column) -> Column:
    """Digits in groups of three."""
    return F.format_number(n.cast("long"), 0)


def seconds(ticks: Column, frequency: float) -> Column:
    return ticks / F.lit(frequency)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def file_folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)


def file_extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./\\]*)$", 1)


def with_extension(path: Column, extension: str) -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^./\\]*$", ""), F.lit("." + extension))


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./\\]*$", "")


def make_path(folder: Column, name: Column) -> Column:
    """Folder and name with one slash between; an empty folder adds none."""
    return F.when(folder == "", name).otherwise(F.concat(F.regexp_replace(folder, r"[/\\]+$", ""), F.lit("/"), name))
