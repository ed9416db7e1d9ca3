"""Intermediate results that outlive an executor, in the folder that all share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder where that is unset and one machine runs
    all, as in tests. On a cluster it must be set."""
    sc = spark.sparkContext
    got = spark.conf.get("spark.checkpoint.dir", None)
    held = sc._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not got and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(got or "file://" + tempfile.mkdtemp(prefix="siftwell-"))
        held = sc._jsc.sc().getCheckpointDir()
    return got.rstrip("/") if got else held.get().rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """df computed once into the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes what is no longer read, wherever it lies."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
