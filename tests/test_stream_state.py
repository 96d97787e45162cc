"""Image state in a stream: the same images as whole, however frames are dealt into batches; cuts, borders and idle state."""

import os
import time

import pytest
from pyspark.sql import functions as F

from voxelspark.operators import image
from voxelspark.streaming import sequences, tiles

from .test_long_sequences import SCHEMA, close, images


def put(spark, rows, folder, k, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/part={k}")
    for name in os.listdir(f"{folder}/part={k}"):
        os.utime(f"{folder}/part={k}/{name}", (1_700_000_000 + k, 1_700_000_000 + k))


def shown(df, frame):
    return {(p["x"], p["y"]): (p["r"], p["g"], p["b"], p["a"]) for p in df.where(F.col("frame") == frame).collect()}


def test_tiles_with_borders_give_the_whole_image(spark, tmp_path):
    rows, df = images(spark, 4, size=10)
    folder = str(tmp_path / "in")
    put(spark, [r for r in rows if r[0] < 2], folder, 0)
    for k in (2, 3):
        put(spark, [r for r in rows if r[0] == k], folder, k)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    got = sequences.run_to_end(tiles.blend_tiles(stream.select(*[c.split()[0] for c in SCHEMA.split(", ")]), 0.25, 10, 10, tile=4, halo=12), "append")
    assert got.count() == 400
    for frame in (0, 1, 3):
        whole = image.temporal_resolve(df.where(F.col("frame") <= frame), 0.25, 10, 10)
        close(shown(got, frame), {(p["x"], p["y"]): (p["r"], p["g"], p["b"], p["a"]) for p in whole.collect()})


def test_cuts_begin_anew_and_narrow_borders_fail(spark, tmp_path):
    rows, df = images(spark, 3, size=6)
    folder, schema = str(tmp_path / "in"), SCHEMA + ", cut boolean"
    put(spark, [(*r, r[0] == 2) for r in rows], folder, 0, schema)
    stream = spark.readStream.schema(schema).parquet(folder).drop("part")
    got = sequences.run_to_end(tiles.blend_tiles(stream, 0.25, 6, 6, tile=3, halo=4), "append")
    close(shown(got, 2), {(r[1], r[2]): (*r[3:6], float(r[8] > 0)) for r in rows if r[0] == 2})
    with pytest.raises(Exception, match="beyond the border"):
        sequences.run_to_end(tiles.blend_tiles(stream, 0.25, 6, 6, tile=3, halo=2), "append")


def test_idle_state_goes(spark, tmp_path):
    rows, df = images(spark, 2, size=4)
    folder = str(tmp_path / "in")
    put(spark, [r for r in rows if r[0] == 0], folder, 0)
    stream = spark.readStream.schema(SCHEMA).parquet(folder).drop("part")
    found = []
    blended = tiles.blend_tiles(stream, 0.25, 4, 4, tile=4, halo=6, idle_ms=1500)
    query = blended.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").foreachBatch(lambda b, _: found.extend(b.collect())).start()
    try:
        until = time.time() + 90
        while len(found) < 16 and time.time() < until and query.isActive:
            time.sleep(0.5)
        time.sleep(4)  # longer than the state may be idle
        put(spark, [r for r in rows if r[0] == 1], folder, 1)
        while len(found) < 32 and time.time() < until and query.isActive:
            time.sleep(0.5)
    finally:
        query.stop()
    last = {(p["x"], p["y"]): (p["r"], p["g"], p["b"], p["a"]) for p in found if p["frame"] == 1}
    close(last, {(r[1], r[2]): (*r[3:6], float(r[8] > 0)) for r in rows if r[0] == 1})  # as if it were the first
