"""Block colour compression, box downscaling and mip-chain sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_ENDS = (("r", 16), ("g", 8), ("b", 0))


def bc1_blocks(pixels: DataFrame, size: int = 4, quality: int = 0) -> DataFrame:
    """Two end colours for each tile of ``size`` x ``size`` pixels, and 2 bits for each pixel, from ``(x, y, r, g, b)``.

    Ends are the tile's least and greatest channel values (``quality`` 0), or the colours of its darkest and its brightest
    pixel by r + 2 g + b, ties by colour (``quality`` 1), or of its extreme pixels along the principal axis of its colours, where
    that gives a smaller error than ``quality`` 0 (``quality`` 2).  The palette is both ends, then one third and two thirds of the way,
    rounded toward zero; a pixel takes the nearest by squared distance, the first of equal ones.  One shuffle: a tile's pixels,
    ``size`` * ``size`` at most, are gathered in its row."""
    tile = pixels.select(*[F.expr(f"{c} div {size}").cast("int").alias("t" + c) for c in "xy"], F.expr(f"cast(x % {size} + {size} * (y % {size}) as int)").alias("c"), "r", "g", "b")
    if quality == 2:
        return _principal_blocks(tile)
    if quality:
        ends = lambda k, f: f(F.struct(F.expr("r + 2 * g + b").alias("l"), "r", "g", "b"))
        aggregates = [ends(0, F.min).alias("e0"), ends(1, F.max).alias("e1")]
    else:
        aggregates = [F.struct(*[f(c).alias(c) for c in "rgb"]).alias(f"e{k}") for k, f in ((0, F.min), (1, F.max))]
    block = tile.groupBy("tx", "ty").agg(*aggregates, F.collect_list(F.struct("c", "r", "g", "b")).alias("cells"))
    return _words(block.withColumn("coded", F.expr(_coded("e0", "e1"))))


def _coded(e0: str, e1: str) -> str:
    """The nearest of a block's four colours for each of its pixels, with the squared distance."""
    parts = [f"{e0}.{{c}}", f"{e1}.{{c}}", f"(2 * {e0}.{{c}} + {e1}.{{c}}) div 3", f"({e0}.{{c}} + 2 * {e1}.{{c}}) div 3"]
    distance = [" + ".join(f"(v.{c} - ({p.format(c=c)})) * (v.{c} - ({p.format(c=c)}))" for c in "rgb") for p in parts]
    best = "array_min(array(" + ", ".join(f"struct(cast({d} as bigint) as d, {k} as k)" for k, d in enumerate(distance)) + "))"
    return f"transform(cells, v -> struct(v.c as c, {best} as best))"


def _words(coded: DataFrame) -> DataFrame:
    """Ends, index words and error of coded tiles."""
    end = lambda k: F.expr(" | ".join(f"shiftleft(cast(e{k}.{c} as bigint), {s})" for c, s in _ENDS))
    return coded.select(
        "tx", "ty", end(0).alias("end0"), end(1).alias("end1"), F.expr("aggregate(coded, 0L, (a, v) -> a | shiftleft(cast(v.best.k as bigint), 2 * v.c))").alias("indexes"),
        F.expr("aggregate(coded, 0L, (a, v) -> a + v.best.d)").alias("error"), F.size("coded").cast("long").alias("pixels"),
    )


#: Rounds of the power iteration.
ROUNDS = 8


def _principal_blocks(tile: DataFrame) -> DataFrame:
    """Tiles coded between the extreme pixels along their principal axis, or between least and greatest channels where that is no
    worse.

    Sums, products and pixels of a tile come from one aggregate; its covariance is exact, n times over, in integers.  The axis is
    that of a power iteration from (1, 1, 1), scaled by its largest component; a tile of one colour has none and keeps that."""
    moment = [F.sum(F.col(a).cast("long") * F.col(b)).alias(f"{a}{b}") for a, b in ("rr", "rg", "rb", "gg", "gb", "bb")]
    block = tile.groupBy("tx", "ty").agg(
        *[F.struct(*[f(c).alias(c) for c in "rgb"]).alias(n) for n, f in (("l0", F.min), ("l1", F.max))],
        *[F.sum(F.col(c).cast("long")).alias(f"s{c}") for c in "rgb"], *moment, F.count("*").alias("n"), F.collect_list(F.struct("c", "r", "g", "b")).alias("cells"),
    )
    block = block.withColumns({f"v{a}{b}": F.expr(f"cast(n * {a}{b} - s{a} * s{b} as double)") for a, b in ("rr", "rg", "rb", "gg", "gb", "bb")})
    turned = "struct(vrr * a.x + vrg * a.y + vrb * a.z as x, vrg * a.x + vgg * a.y + vgb * a.z as y, vrb * a.x + vgb * a.y + vbb * a.z as z)"
    longest = "greatest(abs(w.x), abs(w.y), abs(w.z))"
    scaled = f"transform(array({turned}), w -> if({longest} = 0, a, struct(w.x / {longest} as x, w.y / {longest} as y, w.z / {longest} as z)))[0]"
    block = block.withColumn("axis", F.expr(f"aggregate(sequence(1, {ROUNDS}), struct(1D as x, 1D as y, 1D as z), (a, i) -> {scaled})"))
    placed = "transform(cells, v -> struct(v.r * axis.x + v.g * axis.y + v.b * axis.z as at, v.r as r, v.g as g, v.b as b))"
    block = block.withColumn("placed", F.expr(placed)).withColumns({"p0": F.expr("array_min(placed)"), "p1": F.expr("array_max(placed)")})
    block = block.withColumns({"by_box": F.expr(_coded("l0", "l1")), "by_axis": F.expr(_coded("p0", "p1"))})
    error = "aggregate({}, 0L, (a, v) -> a + v.best.d)"
    block = block.withColumn("_axis", F.expr(f"{error.format('by_axis')} < {error.format('by_box')}"))
    ends = {f"e{k}": F.expr(f"if(_axis, struct(p{k}.r as r, p{k}.g as g, p{k}.b as b), l{k})") for k in (0, 1)}
    return _words(block.withColumns(ends | {"coded": F.expr("if(_axis, by_axis, by_box)")}))


def texture(pixels: DataFrame, width: int, quality: int = 0) -> DataFrame:
    """Coded tiles of a square image and of its halvings down to 4 pixels, each with its level and its byte offset in the file:
    levels follow each other, tiles go by row, 8 bytes each."""
    out, level, start = None, 0, 0
    while True:
        tiles = (width + 3) // 4
        blocks = bc1_blocks(pixels, 4, quality).select(F.lit(level).alias("level"), "*", (F.lit(start) + (F.col("ty") * tiles + F.col("tx")) * 8).cast("long").alias("at"))
        out = blocks if out is None else out.unionByName(blocks)
        start, level, width = start + 8 * tiles * tiles, level + 1, width >> 1
        if width < 4:
            return out
        pixels = downscale(pixels)


def bc1_pixels(blocks: DataFrame, size: int = 4) -> DataFrame:
    """Pixels of tiles as ``bc1_blocks`` codes them; a tile at an edge gives pixels beyond it too."""
    place = blocks.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(size * size - 1))))
    place = place.withColumn("i", F.expr("cast((shiftright(indexes, 2 * k) & 3) as int)"))
    ends = [(c, F.expr(f"cast(shiftright(end0, {s}) & 255 as int)"), F.expr(f"cast(shiftright(end1, {s}) & 255 as int)")) for c, s in (("r", 16), ("g", 8), ("b", 0))]
    place = place.withColumns({f"{c}{k}": e for c, a, b in ends for k, e in ((0, a), (1, b))})
    pick = "cast(case i when 0 then {c}0 when 1 then {c}1 when 2 then (2 * {c}0 + {c}1) div 3 else ({c}0 + 2 * {c}1) div 3 end as int)"
    return place.select(F.expr(f"tx * {size} + k % {size}").cast("int").alias("x"), F.expr(f"ty * {size} + k div {size}").cast("int").alias("y"), *[F.expr(pick.format(c=c)).alias(c) for c in "rgb"])


def block_colors(cells: DataFrame, *extra: str) -> DataFrame:
    """Blocks of 4 x 4 x 4 cells from the colours of leaves ``(x, y, z, r, g, b)``: presence of the 64 cells as two 32-bit masks,
    two end colours, and 2 bits for each cell in four 32-bit words of 16 cells (0 where there is no cell).

    Ends, palette and ties as in ``bc1_blocks``.  One shuffle: a block's cells, 64 at most, are gathered in its row.  ``error``
    is the sum of squared distances."""
    cell = F.struct(F.expr("(x & 3) | shiftleft(y & 3, 2) | shiftleft(z & 3, 4)").alias("c"), "r", "g", "b")
    block = cells.select(*extra, *[F.shiftright(c, 2).alias("b" + c) for c in "xyz"], "r", "g", "b", cell.alias("cell"))
    block = block.groupBy(*extra, "bx", "by", "bz").agg(
        *[f(c).alias(f"{c}{k}") for c in "rgb" for k, f in ((0, F.min), (1, F.max))], F.array_sort(F.collect_list("cell")).alias("cells_")
    )
    parts = ["{c}0", "{c}1", "(2 * {c}0 + {c}1) div 3", "({c}0 + 2 * {c}1) div 3"]
    distance = [" + ".join(f"(v.{c} - ({p.format(c=c)})) * (v.{c} - ({p.format(c=c)}))" for c in "rgb") for p in parts]
    best = "array_min(array(" + ", ".join(f"struct(cast({d} as bigint) as d, {k} as k)" for k, d in enumerate(distance)) + "))"
    coded = block.withColumn("coded", F.expr(f"transform(cells_, v -> struct(v.c as c, {best} as best))"))
    mask = lambda lo: F.expr(f"aggregate(coded, 0L, (a, v) -> a | case when v.c div 32 = {lo} then shiftleft(1L, v.c % 32) else 0L end)")
    word = lambda k: F.expr(f"aggregate(coded, 0L, (a, v) -> a | case when v.c div 16 = {k} then shiftleft(cast(v.best.k as bigint), 2 * (v.c % 16)) else 0L end)")
    end = lambda k: F.expr(" | ".join(f"shiftleft(cast({c}{k} as bigint), {s})" for c, s in _ENDS))
    return coded.select(
        *extra, "bx", "by", "bz", mask(0).alias("presence0"), mask(1).alias("presence1"), end(0).alias("end0"), end(1).alias("end1"),
        *[word(k).alias(f"idx{k}") for k in range(4)], F.expr("aggregate(coded, 0L, (a, v) -> a + v.best.d)").alias("error"), F.size("coded").alias("cells"),
    )


def cell_color(channel: str, cell: str) -> Column:
    """A channel of the colour that a coded block has for a cell, 0 to 63, by its two ends and index words."""
    shift = dict(_ENDS)[channel]
    index = f"cast(shiftright(element_at(array(idx0, idx1, idx2, idx3), cast({cell} div 16 as int) + 1), 2 * ({cell} % 16)) & 3 as int)"
    a, b = (f"(shiftright(end{k}, {shift}) & 255)" for k in (0, 1))
    return F.expr(f"cast(case {index} when 0 then {a} when 1 then {b} when 2 then (2 * {a} + {b}) div 3 else ({a} + 2 * {b}) div 3 end as int)")


def block_cells(blocks: DataFrame, *extra: str) -> DataFrame:
    """Cells and colours of blocks as ``block_colors`` codes them; only cells that are present."""
    cell = blocks.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(63))))
    cell = cell.where("(shiftright(if(c < 32, presence0, presence1), c % 32) & 1) = 1")
    at = [F.expr(f"b{a} * 4 + (shiftright(c, {s}) & 3)").alias(a) for a, s in (("x", 0), ("y", 2), ("z", 4))]
    return cell.select(*extra, *at, *[cell_color(c, "c").alias(c) for c in "rgb"])


def mip_images(pixels: DataFrame, levels: int) -> DataFrame:
    """The image and its ``levels`` - 1 halvings, each from the one before."""
    out = pixels.select(F.lit(0).alias("level"), "x", "y", "r", "g", "b")
    for k in range(1, levels):
        pixels = downscale(pixels)
        out = out.unionByName(pixels.select(F.lit(k).alias("level"), "x", "y", "r", "g", "b"))
    return out


def downscale(pixels: DataFrame) -> DataFrame:
    """Means of 2 x 2 pixels, rounded down; an odd edge averages what there is."""
    return pixels.groupBy(*[F.expr(f"{c} div 2").cast("int").alias(c) for c in "xy"]).agg(*[F.expr(f"cast(sum({c}) div count(*) as int)").alias(c) for c in "rgb"])


def mip_chain(widths: DataFrame) -> DataFrame:
    """Levels and bytes of a square image's chain down to 4 pixels, at 8 bytes for each tile of 4 x 4."""
    levels = F.expr("filter(transform(sequence(0, 30), k -> shiftright(width, k)), w -> w >= 4)")
    size = F.expr("aggregate(levels, 0L, (a, w) -> a + 8L * ((w + 3) div 4) * ((w + 3) div 4))")
    return widths.withColumn("levels", levels).select("width", F.size("levels").alias("mips"), size.alias("bytes"))
