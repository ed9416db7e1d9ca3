"""A published index: Parquet tables in a version folder, and a pointer to the current one.

The pointer is replaced last and in one step, so a reader sees a whole version or the one
before. Postings are sorted by term within their files, so a search for few terms reads
few row groups. Superseded versions are found by this module's own naming, never by a
path that an index holds.
"""

from __future__ import annotations

import json
import os
import re
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators import index as I

SCHEMA = 2
_VERSION = re.compile(r"v-[0-9a-f]{16}-\d+$")
POINTER = "_CURRENT"


def publish(root: str, units: DataFrame, edges: DataFrame, vectors: DataFrame | None, meta: dict, more: dict | None = None) -> str:
    """Writes a version under root (a folder on this machine or a mounted store); more:
    further tables by name."""
    os.makedirs(root, exist_ok=True)
    stamp = str(meta.get("fingerprint", ""))[:16].ljust(16, "0")
    number = 1 + max([int(n.rsplit("-", 1)[1]) for n in os.listdir(root) if _VERSION.match(n)], default=0)
    name = f"v-{stamp}-{number}"
    at = f"{root}/{name}"
    units.write.parquet(f"{at}/units")
    spark = units.sparkSession
    stored = spark.read.parquet(f"{at}/units")  # what was written is what is indexed
    I.postings(stored).repartition("term").sortWithinPartitions("term", "unit_id").write.parquet(f"{at}/postings")
    edges.write.parquet(f"{at}/edges")
    if vectors is not None:
        vectors.withColumn("vector", F.col("vector").cast("array<float>")).write.parquet(f"{at}/vectors")
    for table, df in (more or {}).items():
        df.write.parquet(f"{at}/{table}")
    with open(f"{at}/meta.json", "w", encoding="utf-8") as f:
        json.dump({"schema": SCHEMA, "fingerprint": "", "build_fingerprint": "", "descriptions_fingerprint": ""} | meta, f)
    temp = f"{root}/.{POINTER}.{os.getpid()}"
    with open(temp, "w", encoding="utf-8") as f:
        f.write(name)
    os.replace(temp, f"{root}/{POINTER}")
    for old in os.listdir(root):
        if _VERSION.match(old) and int(old.rsplit("-", 1)[1]) < number - 1:  # a reader may still hold the one before
            shutil.rmtree(f"{root}/{old}", ignore_errors=True)
    return name


def load(spark: SparkSession, root: str) -> dict:
    """units, postings, edges, vectors, meta and degraded (None, or why vectors are
    missing)."""
    with open(f"{root}/{POINTER}", encoding="utf-8") as f:
        name = f.read().strip()
    if not _VERSION.match(name):
        raise ValueError(f"the index pointer names {name!r}")
    at = f"{root}/{name}"
    with open(f"{at}/meta.json", encoding="utf-8") as f:
        meta = {"fingerprint": "", "build_fingerprint": "", "descriptions_fingerprint": ""} | json.load(f)
    got = {t: spark.read.parquet(f"{at}/{t}") for t in ("units", "postings", "edges")} | {"meta": meta, "degraded": None}
    got |= {t: spark.read.parquet(f"{at}/{t}") for t in ("files", "diagnostics") if os.path.isdir(f"{at}/{t}")}
    try:
        got["vectors"] = spark.read.parquet(f"{at}/vectors")
        bad = got["vectors"].where(F.size("vector") != meta.get("dimensions", 0)).limit(1).count()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        bad = 1
    if bad:
        got["vectors"] = spark.createDataFrame([], "unit_id string, vector array<float>")
        got["degraded"] = "vector_store_unavailable"
    return got
