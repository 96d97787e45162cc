"""Shared folders, written intermediate tables and fixed-size filters for the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a local master (tests) gets a folder of this process, which is then set for the session; on a
    cluster, whose machines would not share such a folder, it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="voxelspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Bytes of an Arrow batch sent to Python: a worker holds a few such batches, however long the texts of a partition are.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the batches of the session's Arrow functions by bytes, not by rows alone; a smaller setting stays.

    The setting is read when a result is computed, long after an operator has returned, so it stays with the session."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


#: Bytes of a row group of an intermediate table, of which each task that writes holds one in memory.
ROW_GROUP = 16 << 20


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no earlier step and lineage stays short.

    They go when ``drop`` says so, the rest, which lazy results still read, when the driver's JVM ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        folder = path.getFileSystem(spark._jsc.hadoopConfiguration())
        folder.mkdirs(path)
        folder.deleteOnExit(path)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` under a fresh name and read it back."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(table._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: 64-bit words of the fixed filter of ids: 4 MB, whatever the size of the input.
FILTER_WORDS = 1 << 19
_FILTER_SEEDS = (11, 23, 47)


def filter_bits(ids: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of ``FILTER_WORDS`` 64-bit words over a column of 64-bit integers.

    Only set words reach the driver: at most ``FILTER_WORDS`` rows.  A filter has no false negatives, so a join that
    follows makes the result exact; a full filter merely prunes less."""
    m = FILTER_WORDS * 64
    slots = F.array(*[F.pmod(F.xxhash64(F.col(column), F.lit(s)), F.lit(m)) for s in _FILTER_SEEDS])
    rows = (
        ids.select(F.explode(slots).alias("slot"))
        .groupBy(F.expr("slot div 64").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits"))
        .toArrow()
    )
    bits = np.zeros(FILTER_WORDS, dtype=np.int64)
    bits[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return bits


def filter_slots(column: Column) -> Column:
    """The slots that ``filter_bits`` sets for an id."""
    m = FILTER_WORDS * 64
    return F.array(*[F.pmod(F.xxhash64(column, F.lit(s)), F.lit(m)) for s in _FILTER_SEEDS])


def filter_has(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Which rows of an (n, 3) array of slots may be in the filter."""
    return (((bits[slots >> 6] >> (slots & 63)) & 1) == 1).all(axis=1)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
