"""Points, grids, boxes and cameras as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]
MIPS = 15  # candidates; beyond them a point has mip 16
OUT_OF_MIPS = 16


def dot(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Of two vectors of any equal length, as are those of the functions below."""
    return reduce(lambda x, y: x + y, [x * y for x, y in zip(a, b, strict=True)])


def each(f: Callable[..., Column], *vectors: tuple[Column, ...]) -> tuple[Column, ...]:
    """A function of components, component by component: ``each(F.least, a, b)``, ``each(lambda x, y: x + y, a, b)``."""
    return tuple(f(*v) for v in zip(*vectors, strict=True))


def length(a: tuple[Column, ...]) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: tuple[Column, ...], epsilon: float = 1.1920929e-07) -> tuple[Column, ...]:
    """Unit vector; unchanged if not longer than ``epsilon``."""
    n = length(a)
    return tuple(F.when(n > epsilon, F.try_divide(x, n)).otherwise(x) for x in a)


def gamma(c: Column, g: float) -> Column:
    return F.pow(F.abs(c), F.lit(g))


def linear_depth(d: Column, scale: Column | float, bias: Column | float) -> Column:
    """1 / (d * scale + bias); null where that is 0."""
    return F.try_divide(F.lit(1.0), d * scale + bias)


def ray(px: Column, py: Column, inv_size: Column, forward: Vec, right: Vec, up: Vec) -> Vec:
    sx, sy = (px + 0.5) * inv_size * 2 - 1, (py + 0.5) * inv_size * 2 - 1
    return tuple(f + r * sx - u * sy for f, r, u in zip(forward, right, up, strict=True))


def along(origin: Vec, direction: Vec, t: Column) -> Vec:
    return tuple(o + d * t for o, d in zip(origin, direction, strict=True))


def mip_of(p: Vec, centres: list[tuple[float, float, float]], half_widths: list[float]) -> Column:
    """The first cube that holds the point strictly inside, else 16."""
    out = None
    for k, (c, h) in enumerate(zip(centres[:MIPS], half_widths[:MIPS], strict=True)):
        inside = (F.abs(p[0] - c[0]) < h) & (F.abs(p[1] - c[1]) < h) & (F.abs(p[2] - c[2]) < h)
        out = F.when(inside, k) if out is None else out.when(inside, k)
    return out.otherwise(OUT_OF_MIPS)


def sky_exit(direction: Vec, lo: float, hi: float) -> Column:
    """Distance at which a ray from the centre leaves the cube [lo, hi]; axes it does not move along do not count."""
    return F.least(*[F.greatest(F.try_divide(F.lit(lo), d), F.try_divide(F.lit(hi), d)) for d in direction])


def sky_sample(p: Vec, mip: Column, direction: Vec, origin: Vec, sky_mip: int, lo: float, hi: float) -> tuple[Vec, Column]:
    """A sample's place and mip: its own below ``sky_mip``, else where its ray leaves the skybox, in that mip."""
    near = mip < sky_mip
    exit_ = along(origin, direction, sky_exit(direction, lo, hi))
    return tuple(F.when(near, a).otherwise(b) for a, b in zip(p, exit_, strict=True)), F.when(near, mip).otherwise(sky_mip)


def uv_inside(u: Column, v: Column) -> Column:
    """Both coordinates are from 0 to 1."""
    return u.between(0, 1) & v.between(0, 1)


def quantise(p: Column, half_width: float, centre: float = 0.0, scale: float = 1.0) -> Column:
    """Cell index, truncated toward zero."""
    return ((p - centre) * (half_width / scale) + half_width).cast("int")


def colour_u8(c: Column) -> Column:
    return (c * 255 + 0.5).cast("int")


@dataclass(frozen=True)
class Onion:
    """Six faces of shells whose distance grows by 2 every ``period`` blocks; ``width`` blocks across."""

    z_min: float = 0.01
    period: int = 4
    width: int = 16


def onion_bounds(o: Onion, sign: Column, axis: Column, bx: Column, by: Column, bz: Column) -> dict[str, Column]:
    """Box of a block; lateral coordinates scale with the far side of the shell."""
    near, far = (F.lit(o.z_min) * F.pow(F.lit(2.0), (bz + k) / F.lit(float(o.period))) for k in (0.0, 1.0))
    u0, u1, v0, v1 = (((b + k) * (2.0 / o.width) - 1.0) * far for b, k in ((bx, 0.0), (bx, 1.0), (by, 0.0), (by, 1.0)))
    low, high = F.when(sign == 1, -far).otherwise(near), F.when(sign == 1, -near).otherwise(far)
    pick = lambda first, second, third: F.when(axis == 0, first).when(axis == 1, second).otherwise(third)
    return {
        "x0": pick(low, v0, u0), "y0": pick(u0, low, v0), "z0": pick(v0, u0, low),
        "x1": pick(high, v1, u1), "y1": pick(u1, high, v1), "z1": pick(v1, u1, high),
    }


def onion_cell(o: Onion, p: Vec) -> dict[str, Column]:
    """The block that holds a point: the axis of its largest coordinate, the shell by its logarithm."""
    ax, ay, az = (F.abs(c) for c in p)
    axis = F.when((ax >= ay) & (ax >= az), 0).when(ay >= az, 1).otherwise(2)
    r = F.greatest(ax, ay, az)
    signed = F.when(axis == 0, p[0]).when(axis == 1, p[1]).otherwise(p[2])
    u = F.when(axis == 0, p[1]).when(axis == 1, p[2]).otherwise(p[0])
    v = F.when(axis == 0, p[2]).when(axis == 1, p[0]).otherwise(p[1])
    bz = F.floor(F.log2(r / o.z_min) * o.period).cast("int")
    far = F.lit(o.z_min) * F.pow(F.lit(2.0), (bz + 1) / F.lit(float(o.period)))
    lateral = lambda c: F.floor((c / far + 1) * (o.width / 2)).cast("int")
    return {"sign": F.when(signed < 0, 1).otherwise(0), "axis": axis, "bx": lateral(u), "by": lateral(v), "bz": bz}


def outside_distance(p: Vec, lo: tuple[float, float, float], hi: tuple[float, float, float]) -> Column:
    """How far a point is outside a box; 0 inside."""
    gap = [F.greatest(F.lit(a) - c, c - F.lit(b), F.lit(0.0)) for c, a, b in zip(p, lo, hi, strict=True)]
    return length(tuple(gap))


def billboard(p: Vec, size: Column, right: tuple[float, float, float], up: tuple[float, float, float]) -> Column:
    """An array of the four corners of a square that faces the view, in the order of their index's bits."""
    corner = lambda k: F.struct(F.lit(k).alias("corner"), *[(c + size * ((2 * (k & 1) - 1) * r + ((k & 2) - 1) * u)).alias(a) for a, c, r, u in zip("xyz", p, right, up, strict=True)])
    return F.array(*[corner(k) for k in range(4)])


def transform(rows: list[list[float]], p: tuple[Column, ...]) -> list[Column]:
    """A 4 x 4 matrix by rows times a point with w = 1, or four coordinates."""
    q = (*p, F.lit(1.0)) if len(p) == 3 else p
    return [sum((F.lit(float(a)) * c for a, c in zip(r[1:], q[1:], strict=True)), F.lit(float(r[0])) * q[0]) for r in rows]


def matmul(*matrices: list[list[float]]) -> list[list[float]]:
    """Product of constant matrices, so that a chain costs one transform."""
    out = matrices[0]
    for m in matrices[1:]:
        out = [[sum(a[k] * m[k][j] for k in range(4)) for j in range(4)] for a in out]
    return out


@dataclass(frozen=True)
class Camera:
    """An orthonormal basis and the tangents of the half fields of view."""

    origin: tuple[float, float, float]
    forward: tuple[float, float, float]
    right: tuple[float, float, float]
    up: tuple[float, float, float]
    tan_x: float
    tan_y: float

    @staticmethod
    def looking(origin: tuple[float, float, float], yaw: float, pitch: float, fov_x: float, fov_y: float) -> Camera:
        """Yaw turns about up, pitch about right; both 0 looks along -z."""
        cy, sy, cp, sp = math.cos(yaw), math.sin(yaw), math.cos(pitch), math.sin(pitch)
        forward, right = (-sy * cp, sp, -cy * cp), (cy, 0.0, -sy)
        up = (right[1] * forward[2] - right[2] * forward[1], right[2] * forward[0] - right[0] * forward[2], right[0] * forward[1] - right[1] * forward[0])
        return Camera(origin, forward, right, up, math.tan(fov_x / 2), math.tan(fov_y / 2))

    def eyes(self, distance: float) -> list[Camera]:
        """Left and right, ``distance`` apart along the right axis."""
        at = lambda s: tuple(o + s * distance / 2 * r for o, r in zip(self.origin, self.right, strict=True))
        return [Camera(at(s), self.forward, self.right, self.up, self.tan_x, self.tan_y) for s in (-1, 1)]

    def view(self, p: Vec) -> Vec:
        """Right, up and depth of a point seen from here."""
        d = tuple(c - o for c, o in zip(p, self.origin, strict=True))
        return tuple(d[0] * a[0] + d[1] * a[1] + d[2] * a[2] for a in (self.right, self.up, self.forward))


def view_rows(spark: SparkSession, views: list[Camera]) -> DataFrame:
    """One row for each view: its number, origin, basis and tangents."""
    rows = [(k, *v.origin, *v.forward, *v.right, *v.up, v.tan_x, v.tan_y) for k, v in enumerate(views)]
    names = [f"{v}{c}" for v in ("o", "f", "r", "u") for c in "xyz"] + ["tan_x", "tan_y"]
    return spark.createDataFrame([(r[0], *map(float, r[1:])) for r in rows], "eye int, " + ", ".join(f"{n} double" for n in names))


def view_basis(yaw: Column, pitch: Column) -> dict[str, Column]:
    """``fx .. uz``: forward, right and up of views that rows describe, as ``Camera.looking`` has them for one."""
    cy, sy, cp, sp = F.cos(yaw), F.sin(yaw), F.cos(pitch), F.sin(pitch)
    forward, right = (-sy * cp, sp, -cy * cp), (cy, F.lit(0.0), -sy)
    up = tuple(right[i] * forward[j] - right[j] * forward[i] for i, j in ((1, 2), (2, 0), (0, 1)))
    return {f"{n}{c}": v for n, axis in (("f", forward), ("r", right), ("u", up)) for c, v in zip("xyz", axis, strict=True)}


def stereo_views(rows: DataFrame, yaw: Column, pitch: Column, distance: float) -> DataFrame:
    """Two rows for each row with an origin ``ox, oy, oz``: eye 0 (left) and 1, ``distance`` apart along the view's right axis,
    with its basis."""
    views = rows.withColumns(view_basis(yaw, pitch)).withColumn("eye", F.explode(F.array(F.lit(0), F.lit(1))))
    return views.withColumns({f"o{c}": F.col(f"o{c}") + (F.col("eye") - 0.5) * distance * F.col(f"r{c}") for c in "xyz"})
