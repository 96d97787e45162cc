"""Pixel neighbourhoods, sharpening, reprojection and blending over time."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.color import from_ycocg, luminance, to_ycocg
from ..functions.hashing import halton
from ..sources.folders import shared_folder
from .scan import SUM, scan


def cross(pixels: DataFrame, values: list[str]) -> DataFrame:
    """Each pixel with the values of its left, right, upper and lower neighbours, as ``<value>_l`` and so on; 0 outside.

    Every pixel sends its value to five places and one aggregate gathers them: a single shuffle, no self joins."""
    places = {"c": (0, 0), "l": (1, 0), "r": (-1, 0), "u": (0, 1), "d": (0, -1)}
    sent = F.explode(F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.lit(k).alias("k"), *values) for k, (dx, dy) in places.items()]))
    rows = pixels.select(sent.alias("s")).select("s.*")
    gathered = rows.groupBy("x", "y").agg(
        F.max(F.col("k") == "c").alias("own"),
        *[F.coalesce(F.max(F.when(F.col("k") == k, F.col(v))), F.lit(0)).alias(v if k == "c" else f"{v}_{k}") for v in values for k in places],
    )
    return gathered.where("own").drop("own")


def stencil_range(pixels: DataFrame, value: str) -> DataFrame:
    """Least and greatest value of a pixel and its four neighbours."""
    around = [F.col(value), *[F.col(f"{value}_{k}") for k in "lrud"]]
    return cross(pixels, [value]).select("x", "y", F.least(*around).alias("low"), F.greatest(*around).alias("high"))


def sharpen(pixels: DataFrame) -> DataFrame:
    """Gain of a pixel by its four neighbours' luminance, where the darkest of the five is over half the brightest."""
    lum = pixels.select("x", "y", luminance((F.col("r"), F.col("g"), F.col("b"))).cast("double").alias("l"), "r", "g", "b")
    wide = cross(lum, ["l", "r", "g", "b"])
    around = [F.col("l"), *[F.col(f"l_{k}") for k in "lrud"]]
    gain = F.try_divide(F.col("l") * 2 - reduce(lambda a, b: a + b, around[1:]) * 0.25, F.col("l"))
    gain = F.when(F.least(*around) > F.greatest(*around) * 0.5, gain).otherwise(1.0)
    return wide.select("x", "y", *[F.round(F.col(c) * gain, 6).alias(c) for c in "rgb"])


def sampled(pixels: DataFrame, history: DataFrame, values: list[str], keep: Sequence[str] = ()) -> DataFrame:
    """``<value>_past`` of the history at a pixel's place (``hx``, ``hy``), by the four pixels around it; missing ones count 0.
    Columns ``keep`` of the pixels go along."""
    fx, fy = F.col("hx") - F.floor("hx"), F.col("hy") - F.floor("hy")
    tap = lambda i, j: F.struct((F.floor("hx") + i).cast("int").alias("tx"), (F.floor("hy") + j).cast("int").alias("ty"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("w"))
    taps = pixels.select("x", "y", *keep, F.explode(F.array(*[tap(i, j) for i in (0, 1) for j in (0, 1)])).alias("t")).select("x", "y", *keep, "t.*")
    past = history.select(F.col("x").alias("tx"), F.col("y").alias("ty"), *[F.col(v).alias(f"{v}_past") for v in values])
    found = taps.join(past, ["tx", "ty"], "left")
    return found.groupBy("x", "y").agg(*[F.first(c).alias(c) for c in keep], *[F.sum(F.coalesce(F.col(f"{v}_past"), F.lit(0)) * F.col("w")).alias(f"{v}_past") for v in values])


def reproject(pixels: DataFrame, history: DataFrame, value: str) -> DataFrame:
    """The history at a pixel's place before it moved, (x - dx, y + dy) as rows count down, by the four pixels around it; missing
    ones count 0."""
    at = pixels.withColumn("hx", F.col("x") - F.col("dx")).withColumn("hy", F.col("y") + F.col("dy"))
    return sampled(at, history, [value]).select("x", "y", F.round(f"{value}_past", 6).alias("past"))


YCOCG = ("lum", "co", "cg")


def _wide(pixels: DataFrame) -> DataFrame:
    wide = to_ycocg(tuple(F.col(c).cast("double") for c in "rgb"))
    return pixels.withColumns(dict(zip(YCOCG, wide, strict=True))).drop("r", "g", "b")


def temporal_step(pixels: DataFrame, history: DataFrame, blend: float, width: int, height: int, jitter: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """One frame blended with its history, both whole images in YCoCg with ``a``; ``pixels`` has displacements too.

    The frame's own colour and ``a`` are taken where the jitter put the pixel's sample: at (x + 1 - jx, y + jy), pixel centres
    being at a half, by the four pixels around, held at the border; (0.5, 0.5) is the pixel itself.  The history is taken at
    (x - dx, y + dy) and clamped to the range of that colour and the pixel's four neighbours, in proportion to the displacement:
    wholly from 2 pixels on.  The response is 1 where that place is off the image or ``a`` of the pixel or of its history is
    above 0, else ``blend``.  ``a`` of the result is 1 or 0."""
    at = cross(pixels, [*YCOCG, "dx", "dy", "a"]).withColumns({"hx": F.col("x") - F.col("dx"), "hy": F.col("y") + F.col("dy")})
    if jitter != (0.5, 0.5):
        held = lambda c, by, most: F.greatest(F.least(F.col(c) + by, F.lit(most - 1.0)), F.lit(0.0))
        places = pixels.select("x", "y", held("x", 0.5 - jitter[0], width).alias("hx"), held("y", jitter[1] - 0.5, height).alias("hy"))
        moved = sampled(places, pixels, [*YCOCG, "a"])
        at = at.drop(*YCOCG, "a").join(moved.select("x", "y", *[F.col(f"{c}_past").alias(c) for c in (*YCOCG, "a")]), ["x", "y"])
    keep = ["dx", "dy", "a", "hx", "hy", *[c + k for c in YCOCG for k in ("", "_l", "_r", "_u", "_d")]]
    both = sampled(at, history, [*YCOCG, "a"], keep)
    inside = F.col("hx").between(-0.5, width - 0.5) & F.col("hy").between(-0.5, height - 0.5)
    response = F.when(~inside | (F.col("a_past") > 0) | (F.col("a") > 0), 1.0).otherwise(blend)
    share = F.least(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) * 0.5, F.lit(1.0))

    def blended(c: str) -> Column:
        around, past = [F.col(c), *[F.col(f"{c}_{k}") for k in "lrud"]], F.col(f"{c}_past")
        past = past + (F.greatest(F.least(past, F.greatest(*around)), F.least(*around)) - past) * share
        return (past + (F.col(c) - past) * response).alias(c)

    return both.select("x", "y", *[blended(c) for c in YCOCG], F.when(F.col("a") > 0, 1.0).otherwise(0.0).alias("a"))


def unchanged_counts(frames: DataFrame, values: Sequence[str] = ("r", "g", "b", "a")) -> DataFrame:
    """``(frame, unchanged)``: how many frames in a row before this one, it included but the first, have shown the same image."""
    before = F.lag(F.struct(*values)).over(Window.partitionBy("x", "y").orderBy("frame"))
    rows = frames.select("frame", (before.isNull() | ~before.eqNullSafe(F.struct(*values))).cast("long").alias("new"))
    each = rows.groupBy("frame").agg(F.max("new").alias("new"))  # a row for each frame
    island = scan(each, "frame", {"past": (F.col("new"), SUM)}).select("frame", (F.coalesce("past", F.lit(0)) + F.col("new")).alias("island"))
    return island.select("frame", (F.row_number().over(Window.partitionBy("island").orderBy("frame")) - 1).alias("unchanged"))


#: Jitters before they come again.
JITTERS = 16


def jitter_offsets(counts: DataFrame) -> DataFrame:
    """``(frame, unchanged, jx, jy)``: the sample's place within the pixel.  A new image begins at the centre; each further frame
    of it takes the next of ``JITTERS`` Halton points by bases 2 and 3."""
    k = F.col("unchanged") % JITTERS
    at = lambda base: F.when(k == 0, 0.5).otherwise(halton(k - 1, base))
    return counts.select("frame", "unchanged", at(2).alias("jx"), at(3).alias("jy"))


def _last_image(spark: SparkSession, folder: str) -> int | None:
    """The last frame whose image was written whole."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    names = [status.getPath() for status in fs.listStatus(path)]
    done = [int(p.getName()[6:]) for p in names if p.getName().startswith("image=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return max(done, default=None)


def temporal_resolve(frames: DataFrame, blend: float, width: int, height: int, jitter: bool = False, every: int = 8, folder: str | None = None) -> DataFrame:
    """The last image of a sequence after ``temporal_step`` frame by frame, from ``(frame, x, y, r, g, b, dx, dy, a)``; the first
    frame has no history and stays as it is.  With ``jitter`` samples move as ``jitter_offsets`` tells.

    A pixel's history depends on its neighbours', so frames go one after the other, each as one distributed step.  Frames are
    written by number first, so that a step reads its own; every ``every`` frames the image is written and read again, so plans
    do not grow with the sequence, and work that was lost goes on from the last image.  ``folder`` keeps these tables: a later
    call with the same folder and more frames goes on from its last image too."""
    spark = frames.sparkSession
    folder = folder or shared_folder(spark, "resolve")
    offsets = {r["frame"]: (r["jx"], r["jy"]) for r in jitter_offsets(unchanged_counts(frames)).collect()} if jitter else {}  # a row for each frame
    order = sorted(r["frame"] for r in frames.select("frame").distinct().collect())
    done = _last_image(spark, folder)
    names = ["x", "y", *YCOCG, "a"]
    image = None if done is None else spark.read.parquet(f"{folder}/image={done}")
    left = [k for k in order if done is None or k > done]
    path = f"{folder}/frames-{left[0] if left else 'none'}"
    frames.where(F.col("frame").isin(left) if done is not None else F.lit(True)).hint("rebalance", "frame").write.mode("overwrite").partitionBy("frame").parquet(path)
    for n, k in enumerate(left):
        now = _wide(spark.read.parquet(f"{path}/frame={k}"))
        first = now.select("x", "y", *YCOCG, F.when(F.col("a") > 0, 1.0).otherwise(0.0).alias("a"))
        image = first if image is None else temporal_step(now, image, blend, width, height, offsets.get(k, (0.5, 0.5)))
        if n % every == every - 1:
            image.write.mode("overwrite").parquet(f"{folder}/image={k}")
            image = spark.read.parquet(f"{folder}/image={k}")
    if image is None:
        image = _wide(frames.drop("frame")).select(*names)
    back = from_ycocg(tuple(F.col(c) for c in YCOCG))
    return image.select("x", "y", *[(F.round(v, 6) + 0.0).alias(c) for c, v in zip("rgb", back, strict=True)], "a")  # no zero below 0


def blend_over_time(frames: DataFrame, key: list[str], value: str, blend: float) -> DataFrame:
    """Exponential history of each key over its frames: new = past + (value - past) * response, where the response is 1 for
    the first frame and after a cut (``cut``), else ``blend``.

    A fold over the frames of one key, which are few; the streaming twin keeps the same state.  Keys have no neighbours here:
    ``temporal_resolve`` is the blend of images, with motion, clamp and response."""
    ordered = F.array_sort(F.collect_list(F.struct("frame", F.col(value).alias("v"), "cut")))
    fold = F.aggregate(
        ordered,
        F.lit(None).cast("double"),
        lambda a, s: F.when(a.isNull() | s["cut"], s["v"]).otherwise(a + (s["v"] - a) * blend),
    )
    return frames.groupBy(*key).agg(F.count("*").alias("frames"), F.round(fold, 6).alias("value"))


def side_by_side(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """Two images as one, the right one moved by the width."""
    return left.unionByName(right.withColumn("x", F.col("x") + width))
