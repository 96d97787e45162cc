"""Rays through a grid of blocks down to their cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codec import cell_color

#: A ray is in a cell, or block, if it stays there for more than this much of its parameter.
STAY = 1e-6
#: Cells that a line can meet in a block of 4 x 4 x 4, and two that it only touches.
STEPS = 12


def blocks_on_rays(rays: DataFrame, blocks: int) -> DataFrame:
    """``(..., bx, by, bz, t0, t1)``: the blocks of a grid of ``blocks`` ^ 3 that each ray ``(ox ... dz)`` passes, in units of cells.

    The planes between blocks cut a ray into pieces; each piece's middle tells its block.  At most 3 (``blocks`` + 1) pieces."""
    cells = 4 * blocks
    crossings = [f"if(d{a} = 0, cast(array() as array<double>), transform(sequence(0, {blocks}), k -> (4 * k - o{a}) / d{a}))" for a in "xyz"]
    within = [f"if(d{a} = 0, if(o{a} >= 0 and o{a} < {cells}, {{free}}, {{none}}), {{pick}}(-o{a} / d{a}, ({cells} - o{a}) / d{a}))" for a in "xyz"]
    enter = "greatest(0.0D, " + ", ".join(w.format(free="-1e300D", none="1e300D", pick="least") for w in within) + ")"
    leave = "least(" + ", ".join(w.format(free="1e300D", none="-1e300D", pick="greatest") for w in within) + ")"
    rows = rays.withColumns({"_in": F.expr(enter), "_out": F.expr(leave)}).where("_in < _out")
    cuts = f"array_sort(array_distinct(concat(array(_in, _out), filter(concat({', '.join(crossings)}), t -> t > _in and t < _out))))"
    rows = rows.withColumn("_cuts", F.expr(cuts))
    piece = "transform(sequence(0, size(_cuts) - 2), i -> struct(_cuts[i] as t0, _cuts[i + 1] as t1, (_cuts[i] + _cuts[i + 1]) / 2 as m))"
    rows = rows.withColumn("_p", F.explode(F.expr(f"filter({piece}, p -> p.t1 - p.t0 > {STAY})")))
    rows = rows.withColumns({f"b{a}": F.expr(f"cast(floor((o{a} + d{a} * _p.m) / 4) as int)") for a in "xyz"} | {"t0": F.col("_p.t0"), "t1": F.col("_p.t1")})
    return rows.drop("_in", "_out", "_cuts", "_p")


def _first_cell() -> str:
    """The walk from cell to cell, an aggregate over steps whose state is the cell, when it was entered, and the hit."""
    plane = {a: f"if(d{a} = 0, 1e300D, (b{a} * 4 + s.{a} + if(d{a} > 0, 1, 0) - o{a}) / d{a})" for a in "xyz"}
    inside = " and ".join(f"s.{a} between 0 and 3" for a in "xyz")
    cell = "(s.x + 4 * s.y + 16 * s.z)"
    present = f"(shiftright(if({cell} < 32, presence0, presence1), {cell} % 32) & 1) = 1"
    moved = ", ".join(f"s.{a} + if(n.{a} = n.l, cast(signum(d{a}) as int), 0) as {a}" for a in "xyz")
    step = f"if({present} and n.l - s.t > {STAY}, struct(s.x as x, s.y as y, s.z as z, s.t as t, {cell} as hit), struct({moved}, greatest(n.l, s.t) as t, s.hit as hit))"
    # the planes of a step are computed once, as the one element of an array
    planes = ", ".join(f"{plane[a]} as {a}" for a in "xyz") + ", least(" + ", ".join(plane.values()) + ") as l"
    begin = ", ".join(f"cast(greatest(0, least(3, floor(o{a} + d{a} * t0) - 4 * b{a})) as int) as {a}" for a in "xyz")
    return f"aggregate(sequence(1, {STEPS}), struct({begin}, t0 as t, cast(null as int) as hit), (s, i) -> if(s.hit is not null or not ({inside}), s, transform(array(struct({planes})), n -> {step})[0]))"


def cell_hits(rays: DataFrame, blocks: DataFrame, grid: int) -> DataFrame:
    """``(ray_id, x, y, z, t, r, g, b)``: the nearest occupied cell of each ray and its decoded colour; rays that meet none are left out.

    ``blocks`` are coded as by ``codec.block_colors``, ``grid`` blocks along each axis; rays have ``ray_id``, origin ``ox, oy, oz`` and
    direction ``dx, dy, dz`` in units of cells, and go forward only.  ``t`` is the ray's parameter where it enters the cell, 0 if it
    begins there.  Rays meet blocks by an equi-join on the block; a block is walked cell by cell on its presence masks; the nearest
    of a ray's hits is a partial and final aggregate.  Ties at six places go to the least cell."""
    found = blocks_on_rays(rays, grid).join(blocks, ["bx", "by", "bz"]).withColumn("_s", F.expr(_first_cell())).where("_s.hit is not null")
    at = [F.expr(f"b{a} * 4 + _s.{a}").alias(a) for a in "xyz"]
    hits = found.withColumn("_c", F.col("_s.hit")).select("ray_id", F.round("_s.t", 6).alias("t"), *at, *[cell_color(c, "_c").alias(c) for c in "rgb"])
    return hits.groupBy("ray_id").agg(F.min(F.struct("t", "x", "y", "z", "r", "g", "b")).alias("h")).select("ray_id", "h.*")
