"""The supplied tables as points, boxes, pixels and frames; the mapping is ours, as they hold no geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as samples of a 64 x 64 x 64 grid: quantity, price / 2000, discount in percent; colours from keys."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").cast("int").alias("x"),
        (F.col("l_extendedprice") / 2000).cast("int").alias("y"),
        (F.col("l_discount") * 100 + 0.5).cast("int").alias("z"),
        (F.col("l_linenumber") % 16).cast("int").alias("mip"),
        (F.col("l_partkey") % 256).cast("int").alias("r"),
        (F.col("l_suppkey") % 256).cast("int").alias("g"),
        (F.col("l_linenumber") * 31 % 256).cast("int").alias("b"),
        F.col("l_orderkey").alias("k"),
        F.col("l_linenumber").alias("n"),
    )


def image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 64 x 64 image: at (quantity, price / 2000) the average key colours, 0 to 255."""
    return cells(spark, sf_dir).groupBy("x", "y").agg(*[F.expr(f"cast(sum(cast({c} as bigint)) div count(*) as int)").alias(c) for c in "rgb"])


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three components of ``embeddings``."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])


def boxes(spark: SparkSession, sf_dir: str, half: float = 0.03, back: float = 1.0) -> DataFrame:
    """A cube around each point, moved in front of the camera."""
    p = points(spark, sf_dir)
    at = {"x": F.col("x"), "y": F.col("y"), "z": F.col("z") - back}
    return p.select(F.col("vec_id").alias("block_id"), *[(at[c] + s * half).alias(f"{c}{k}") for c in "xyz" for k, s in ((0, -1), (1, 1))])


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as frames: a day is a frame, a block is a user and an event type, its payload how often it came."""
    day = F.expr("datediff(cast(ts as date), date'2024-01-01')")
    return (
        table(spark, sf_dir, "events")
        .select(day.cast("int").alias("frame"), F.col("user_id"), F.col("event_type"))
        .groupBy("frame", "user_id", "event_type")
        .agg(F.count("*").cast("int").alias("n"))
    )


def draw_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as frame metrics: draw time from the value, an event mask from the type."""
    mask = F.expr("shiftleft(1, cast(length(event_type) % 4 as int))")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("frame_id"), "user_id", F.round(F.col("value") * 100, 0).cast("long").alias("draw_us"), mask.cast("int").alias("events"))


def moving_images(spark: SparkSession, sf_dir: str, width: int = 64, height: int = 64) -> DataFrame:
    """Whole images in sequence: the line number is the frame, colours are those of ``image``, black where a frame has no cell;
    displacements (``dx``, ``dy``) and pixels that take no history (``a``) go by place and frame."""
    c = cells(spark, sf_dir)
    found = c.groupBy(F.col("n").alias("frame"), "x", "y").agg(*[F.expr(f"cast(sum(cast({c} as bigint)) div count(*) as int)").alias(c) for c in "rgb"])
    places = spark.range(width * height).select(F.expr(f"cast(id % {width} as int)").alias("x"), F.expr(f"cast(id div {width} as int)").alias("y"))
    whole = c.select(F.col("n").alias("frame")).distinct().crossJoin(places).join(found, ["frame", "x", "y"], "left")
    return whole.select(
        "frame", "x", "y", *[F.coalesce(c, F.lit(0)).alias(c) for c in "rgb"],
        (((F.col("x") + F.col("frame")) % 5 - 2) * 0.4).alias("dx"), (((F.col("y") + F.col("frame") * 2) % 5 - 2) * 0.3).alias("dy"),
        F.when((F.col("x") + F.col("y") + F.col("frame")) % 7 == 0, 1.0).otherwise(0.0).alias("a"),
    )
