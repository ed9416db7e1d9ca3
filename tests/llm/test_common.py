"""What the operators share: slices of batches, bounded Arrow batches, the shared folder."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftwell.llm import common


def test_slices_hold_all_rows_in_order():
    texts = ["a" * 10, None, "", "b" * 500, "c" * 5, None, "d" * 90, "e"]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts, pa.string()), pa.array(texts, pa.string())], ["i", "x", "y"])] * 2
    for size in (1, 20, 100, 10_000):
        for columns in ((1,), (1, 2)):
            got = list(common.pieces_of(batches, *columns, size=size))
            assert [i for b in got for i in b.column(0).to_pylist()] == [*range(8)] * 2
            for b in got:  # one row may be larger by itself
                n = sum(len(x or "") for k in columns for x in b.column(k).to_pylist())
                assert n <= size or sum(bool(x) for x in b.column(1).to_pylist()) == 1
    assert list(common.pieces_of([batches[0].slice(0, 0)], 1)) == []
    assert list(common.pieces_of([], 1)) == []


@pytest.mark.parametrize(("held", "want"), [("64m", "8388608b"), ("1g", "8388608b"), ("4m", "4m"), ("1048576b", "1048576b"), ("9000000", "8388608b")])
def test_batches_are_only_made_smaller(spark, held, want):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, held)
        common.small_batches(spark)
        assert spark.conf.get(key) == want
    finally:
        spark.conf.set(key, old)


def test_a_folder_is_removed(spark):
    path = common.fresh_dir(spark, "gone")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    common.removed(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path).count()


def test_batches_of_a_session_reach_python(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, "64m")
        common.small_batches(spark)
        df = spark.range(0, 200, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("x"))
        sizes = df.mapInArrow(lambda it: (pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"]) for b in it), "n long").collect()
        assert sum(r["n"] for r in sizes) == 200 and max(r["n"] for r in sizes) <= 10
    finally:
        spark.conf.set(key, old)


def test_the_driver_gives_memory_back(spark, monkeypatch):
    """Durable tables have the driver's heap collected and its allocator emptied, not each."""
    monkeypatch.setattr(common, "EASE_SECONDS", 3600)
    monkeypatch.setattr(common, "_eased", [float("-inf")])
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans

    def collections():
        return sum(g.getCollectionCount() for g in beans() if "Young" not in g.getName())

    before = collections()
    assert common.durable(spark.range(3)).count() == 3
    assert collections() > before and common._eased[0] > 0
    assert common.ease_driver(spark) is False
    monkeypatch.setattr(common, "EASE_SECONDS", 0)
    version = spark.sparkContext._jvm.java.lang.Runtime.version()
    if (version.feature(), version.update()) >= (17, 9):
        assert common.ease_driver(spark) is True
