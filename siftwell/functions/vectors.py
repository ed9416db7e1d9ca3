"""Signed feature hashing. BLAKE2b has no SQL form, so a pandas UDF hashes the distinct
tokens alone; everything else is joins and sums on sparse rows."""

from __future__ import annotations

import hashlib
import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import tokens

MIN_DIMENSIONS, MAX_DIMENSIONS = 32, 4096


def bucket(token: str, dimensions: int) -> int:
    raw = hashlib.blake2b(token.encode("utf-8"), digest_size=8).digest()
    return struct.unpack(">Q", raw)[0] % dimensions


def sign(token: str, dimensions: int) -> int:
    return 1 if bucket(f"sign:{token}", dimensions) % 2 else -1


def buckets(terms: DataFrame, dimensions: int) -> DataFrame:
    """(term, bucket, sign) of distinct terms."""
    if not MIN_DIMENSIONS <= dimensions <= MAX_DIMENSIONS:
        raise ValueError(f"dimensions must be in [{MIN_DIMENSIONS}, {MAX_DIMENSIONS}], got {dimensions}")

    @F.pandas_udf("struct<bucket:long,sign:long>")
    def both(t: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"bucket": [bucket(x, dimensions) for x in t], "sign": [sign(x, dimensions) for x in t]})

    return terms.select("term", both("term").alias("x")).select("term", "x.bucket", "x.sign")


def sparse_vectors(texts: DataFrame, dimensions: int) -> DataFrame:
    """(unit_id, bucket, value): unit-length vectors in long form, zeros left out."""
    tf = texts.select("unit_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("unit_id", "term").agg(F.count("*").alias("tf"))
    hashed = buckets(tf.select("term").distinct(), dimensions)
    raw = tf.join(hashed, "term").groupBy("unit_id", "bucket").agg(F.sum(F.col("tf") * F.col("sign")).cast("double").alias("v")).where("v <> 0")
    norm = raw.groupBy("unit_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return raw.join(norm, "unit_id").select("unit_id", "bucket", (F.col("v") / F.col("norm")).alias("value"))


def dense(sparse: DataFrame, dimensions: int) -> DataFrame:
    """(unit_id, vector array<double>) for publication."""
    m = sparse.groupBy("unit_id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "value"))).alias("m"))
    at = F.sequence(F.lit(0).cast("long"), F.lit(dimensions - 1).cast("long"))
    return m.select("unit_id", F.transform(at, lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("vector"))


def embed(text: str, dimensions: int) -> list[float]:
    """The vector of one text on the driver; the same as sparse_vectors gives."""
    import math
    import re

    if dimensions < MIN_DIMENSIONS:
        raise ValueError(f"dimensions must be at least {MIN_DIMENSIONS}")
    v = [0.0] * dimensions
    for m in re.finditer(r"[A-Za-z_][A-Za-z0-9_]*|[一-鿿]+|\d+", text):
        w = m.group().lower()
        grams = [w, *(w[i : i + 2] for i in range(len(w) - 1))] if "一" <= w[0] <= "鿿" and len(w) > 1 else [w]
        for t in grams:
            v[bucket(t, dimensions)] += sign(t, dimensions)
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else v
