"""Colours, fades and plots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import clamp, lerp, saturate, smoothstep

RGB = tuple[Column, Column, Column]
#: The named colours, red, green, blue and alpha.
COLORS = {"black": (0, 0, 0, 255), "blue": (0, 0, 255, 255), "gray": (127, 127, 127, 255), "green": (0, 255, 0, 255), "red": (255, 0, 0, 255), "white": (255, 255, 255, 255)}


def color_bits(r: int, g: int, b: int, a: int = 255) -> int:
    """The four bytes as one word, red lowest."""
    return r | g << 8 | b << 16 | a << 24


def to_ycocg(c: RGB) -> RGB:
    co = c[0] - c[2]
    t = c[2] + co * 0.5
    cg = c[1] - t
    return t + cg * 0.5, co, cg


def from_ycocg(c: RGB) -> RGB:
    t = c[0] - c[2] * 0.5
    b = t - c[1] * 0.5
    return c[1] + b, c[2] + t, b


def luminance(c: RGB) -> Column:
    return c[0] + c[1] * 2 + c[2]


def shade(albedo: Column, ny: Column, ns: Column, ambient: float = 0.1, sky: float = 0.3, sun: float = 0.6) -> Column:
    """Ambient, sky by the normal's height and sun by its angle."""
    return albedo * (F.lit(ambient) + F.greatest(F.lit(0.0), ny) * sky + F.greatest(F.lit(0.0), ns) * sun)


def fade_to_black(c: Column, lum: Column, x: Column, y: Column, fade: Column, out_of_range: Column) -> Column:
    """Toward black by ``fade``; where that is 0, toward a dim checkerboard of 8 x 8 tiles by ``out_of_range``."""
    same = F.floor(x / 8) % 2 == F.floor(y / 8) % 2
    board = F.when(same, F.lit(0.01)).otherwise(lum * 0.01)
    return F.when(fade == 0, lerp(c, board, out_of_range)).otherwise(lerp(c, F.lit(0.0), fade))


def vignette(u: Column, v: Column) -> Column:
    """Share of the background: rises smoothly over the last 2 % toward an edge."""
    reach = F.greatest(F.abs(u * 2 - 1), F.abs(v * 2 - 1))
    return smoothstep(saturate((reach - 0.98) * 50.0))


def radial_alpha(u: Column, v: Column) -> Column:
    return F.lit(1.0) - F.sqrt((u * 2 - 1) * (u * 2 - 1) + (v * 2 - 1) * (v * 2 - 1))


def overlay_alpha(kind: Column, alpha: Column, lum: Column) -> Column:
    """Class 0 opaque, class 1 its own alpha, class 2 dark pixels cut out."""
    return F.when(kind == 0, 1.0).when(kind == 1, alpha).otherwise(F.when(lum < 0.25, 0.0).otherwise(1.0))


def plot_fade(time_us: Column, y: Column, scale: float, height: int) -> Column:
    t = F.least(time_us * scale, F.lit(float(height - 1)))
    return clamp(t - y, 0.0, 1.0) * 0.25


def grid_fade(y: Column, unit_us: float, scale: float) -> Column:
    return F.when(y > 0, (F.lit(1.0) - saturate(y.cast("double") % F.lit(unit_us * scale))) * 0.25).otherwise(0.0)
