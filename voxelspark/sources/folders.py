"""Tables that are written on the way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; it goes with the driver.

    Where that is unset, a local master gets a folder of its own; on a cluster it is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="voxelspark-")
        spark.conf.set("spark.checkpoint.dir", shared)
    root = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration())
    folder.mkdirs(path)
    folder.deleteOnExit(path)
    return root
