"""What the operators share: table paths, durable intermediate results, hashes."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


#: Bytes of an Arrow batch: executors hold several at once, in the JVM and in Python.
BATCH_BYTES = 8 << 20
#: Rows by which the driver finds the bounds of a range partitioning, of any number of
#: partitions up to that (Spark draws up to three times as many).
SAMPLED = 1 << 13
#: Seconds between two times that the driver gives memory back.
EASE_SECONDS = 10
_eased = [0.0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, where nobody has set them lower: Spark's own
    bound, 64 MB for each running task and direction, is a large part of a small executor."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key, "64m").lower().removesuffix("b")
    unit = {"k": 10, "m": 20, "g": 30}.get(held[-1:], 0)
    if int(held.rstrip("kmg")) << unit > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is
    unset and one machine runs all (tests), a temporary folder that is made once."""
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
    """df computed once into the shared folder; a lost executor costs nothing."""
    shared_dir(df.sparkSession)
    got = df.checkpoint(eager=True)
    ease_driver(df.sparkSession)
    return got


def ease_driver(spark: SparkSession) -> bool:
    """Has the driver's JVM collect its heap, which also lets Spark's cleaner drop what no
    table needs any more, and return to the system what its threads have freed outside the
    heap; both otherwise pile up over the jobs of a long query. At most once in
    EASE_SECONDS. Whether memory outside the heap could be given back: not every JVM has
    that command."""
    if time.monotonic() - _eased[0] < EASE_SECONDS:
        return False
    _eased[0] = time.monotonic()
    sc = spark.sparkContext
    sc._jvm.System.gc()
    new, kind = sc._gateway.new_array, sc._jvm.java.lang.Class.forName
    kinds, args = new(sc._jvm.java.lang.Class, 4), new(sc._jvm.java.lang.Object, 4)
    for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = kind(name)
    args[0] = sc._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    args[1], args[2], args[3] = "systemTrimNativeHeap", new(sc._jvm.java.lang.Object, 0), new(sc._jvm.java.lang.String, 0)
    server = sc._jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    try:
        kind("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, args)
    except Py4JJavaError:
        return False
    return True


@contextlib.contextmanager
def few_samples(spark: SparkSession, partitions: int):
    """Range partitioning that runs within draws SAMPLED rows at most for its bounds.
    Spark's own number, 100 for each partition, grows with the input on the driver."""
    key = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    held = spark.conf.get(key)
    spark.conf.set(key, str(max(1, min(int(held), SAMPLED // partitions))))
    try:
        yield
    finally:
        spark.conf.set(key, held)


def fresh_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Deletes what is no longer read, wherever it lies."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces_of(batches, *texts: int, size: int = 1 << 22):
    """The record batches cut into slices whose text columns (by number) hold about size
    bytes, one row at least, so that what is made of a slice stays small beside it."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = sum(np.cumsum(pc.fill_null(pc.binary_length(b.column(t)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) for t in texts)
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            yield b.slice(at, to - at)
            at = to
    give_back()


def give_back() -> None:
    """Returns what this worker has freed to the system; workers stay for other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)
