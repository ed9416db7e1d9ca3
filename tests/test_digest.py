"""A digest in parts is that of the whole stream."""

import hashlib

import pytest
from pyspark.sql import functions as F

from siftwell.operators import snapshot


@pytest.mark.parametrize("most", [1 << 30, 2000, 300])
def test_ordered_digest_in_parts(spark, monkeypatch, most):
    monkeypatch.setattr(snapshot, "DIGEST_BYTES", most)
    rows = [(f"k{(i * 37) % 211:03d}", "é读" * (i % 9) + "x" * (i * i % 150)) for i in range(211)] + [("k300", None), ("k301", "")]
    df = spark.createDataFrame(rows, "k string, t string").repartition(3)
    want = hashlib.sha256("".join(t or "" for _, t in sorted(rows, key=lambda r: r[0])).encode()).hexdigest()
    assert tuple(snapshot.ordered_digest(df, "k", F.col("t")).first()) == (213, want)
    assert tuple(snapshot.ordered_digest(df.where("k < 'a'"), "k", F.col("t")).first()) == (0, hashlib.sha256().hexdigest())


def test_a_task_reads_one_part(spark, monkeypatch):
    """Before, one task read all rows."""
    monkeypatch.setattr(snapshot, "DIGEST_BYTES", 20_000)
    df = spark.range(0, 2000, 1, 4).select(F.format_string("%05d", "id").alias("k"), F.sha2(F.col("id").cast("string"), 512).alias("t"))
    spark.sparkContext.setJobGroup("digest", "")
    try:
        assert snapshot.ordered_digest(df, "k", F.col("t")).first()["n"] == 2000
    finally:
        spark.sparkContext.setJobGroup("other", "")
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = [store.lastStageAttempt(s) for j in tracker.getJobIdsForGroup("digest") for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)]
    most = max(s.inputRecords() + s.shuffleReadRecords() for s in stages if s.numTasks() == 1)
    assert 0 < most < 1000


def test_a_state_goes_on(spark):
    lib = snapshot._libcrypto()
    if lib is None:
        pytest.skip("no libcrypto")
    parts, state = [b"a" * 63, b"", b"b" * 200, b"c"], None
    for p in parts:
        state, digest = snapshot._hashed_on(lib, state, [p])
    assert digest == hashlib.sha256(b"".join(parts)).hexdigest()
