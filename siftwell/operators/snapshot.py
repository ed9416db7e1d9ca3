"""Snapshots, differences, serials and what an incremental rebuild may keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable

ORDER = ("path", "start_line", "qualified_name", "unit_id")


def digest(c):
    return F.sha2(F.encode(c, "UTF-8"), 256)


def stale_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) of files that were added, removed or changed; old, new: path, stat."""
    j = old.select("path", F.col("stat").alias("a")).join(new.select("path", F.col("stat").alias("b")), "path", "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return j.select("path", change.alias("change")).where("change is not null")


def incremental_split(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, action): reuse a file whose content is unchanged and that had units, else
    parse it. old, new: path, sha256."""
    j = new.join(old.select("path", F.col("sha256").alias("was")), "path", "left")
    return j.select("path", F.when(F.col("was") == F.col("sha256"), "reuse").otherwise("parse").alias("action"))


def global_serials(u: DataFrame, width: int | None = None) -> DataFrame:
    """(unit_id, serial) from 1 in ORDER, distributed: rows are range partitioned and sorted,
    that order is written once, and each row's place in its partition moves up by the
    sizes of the partitions in front. Only one row per partition meets in one place."""
    cols = [c for c in ORDER if c in u.columns]
    key = u.select(*cols)
    ranged = key.repartitionByRange(*cols) if width is None else key.repartitionByRange(width, *cols)
    # within a partition monotonically_increasing_id counts rows in its low 33 bits
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = durable(ranged.sortWithinPartitions(*cols).select("unit_id", F.spark_partition_id().alias("part"), place.alias("place")))
    per = placed.groupBy("part").agg(F.count("*").alias("n")).coalesce(1)
    before = per.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return placed.join(F.broadcast(before), "part").select("unit_id", (F.col("before") + F.col("place") + 1).cast("long").alias("serial"))


def stable_serials(u: DataFrame, previous: DataFrame) -> DataFrame:
    """(unit_id, serial): a unit keeps its old serial if that is positive and it claims it
    first in ORDER; the others get numbers above the old maximum, in ORDER. previous:
    unit_id, serial."""
    cols = [c for c in ORDER if c in u.columns]
    j = u.select(*cols).join(previous.select("unit_id", F.col("serial").alias("old")), "unit_id", "left")
    claim = Window.partitionBy("old").orderBy(*cols)
    kept = j.where("old > 0").withColumn("rn", F.row_number().over(claim)).where("rn = 1").select("unit_id", F.col("old").alias("serial"))
    rest = j.join(kept, "unit_id", "left_anti")
    top = previous.agg(F.coalesce(F.greatest(F.max("serial"), F.lit(0)), F.lit(0)).alias("top"))
    fresh = global_serials(rest.select(*cols)).crossJoin(F.broadcast(top)).select("unit_id", (F.col("serial") + F.col("top")).alias("serial"))
    return kept.select("unit_id", F.col("serial").cast("long").alias("serial")).unionByName(fresh)


def vector_reuse(u: DataFrame, previous: DataFrame) -> DataFrame:
    """(unit_id, reused): text, width and serial all unchanged. Both: unit_id, text_sha,
    width, serial."""
    p = previous.select("unit_id", *[F.col(c).alias(f"old_{c}") for c in ("text_sha", "width", "serial")])
    j = u.join(p, "unit_id", "left")
    same = (F.col("text_sha") == F.col("old_text_sha")) & (F.col("width") == F.col("old_width")) & (F.col("serial") == F.col("old_serial"))
    return j.select("unit_id", F.coalesce(same, F.lit(False)).alias("reused"))


#: Bytes that one task of an ordered digest reads, about.
DIGEST_BYTES = 128 << 20
#: Of libcrypto: room for a SHA256_CTX, whose bytes are the whole state of a hash.
_STATE = 256


def _libcrypto():
    """OpenSSL's library, where its SHA-256 takes up a state that was put down; else None."""
    import ctypes
    import ctypes.util
    import hashlib

    try:
        lib = ctypes.CDLL(ctypes.util.find_library("crypto") or "libcrypto.so.3")
        lib.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
        got = _hashed_on(lib, _hashed_on(lib, None, [b"ab" * 50])[0], [b"", b"c" * 77])[1]
    except (OSError, AttributeError):
        return None
    return lib if got == hashlib.sha256(b"ab" * 50 + b"c" * 77).hexdigest() else None


def _hashed_on(lib, state: bytes | None, parts) -> tuple[bytes, str]:
    """(state, hexdigest so far) of SHA-256 from a state on, over byte strings."""
    import ctypes

    now, out = ctypes.create_string_buffer(state or b"", _STATE), ctypes.create_string_buffer(32)
    if state is None:
        lib.SHA256_Init(now)
    for x in parts:
        lib.SHA256_Update(now, x, len(x))
    held = now.raw
    lib.SHA256_Final(out, now)
    return held, out.raw.hex()


def ordered_digest(rows: DataFrame, order: str, text) -> DataFrame:
    """(n, fingerprint): SHA-256 over the texts of all rows, one after the other in the
    order of a column. Such a digest is one stream by its nature. The rows are written once,
    range partitioned in parts of about DIGEST_BYTES; one task after the other then takes up
    the state of the hash where the last one put it down, and sorts and reads its own part
    alone. Rows of equal keys lie in one part."""
    import hashlib
    import uuid

    import pyarrow as pa

    from .durable import removed, shared_dir

    spark = rows.sparkSession
    x = rows.select(F.col(order).alias("k"), F.coalesce(text, F.lit("")).alias("x"))

    def texts(batches, count: list):
        for b in batches:
            count[0] += b.num_rows
            for v in b.column(0).to_pylist():
                yield v.encode("utf-8", "surrogatepass")

    def run(state: bytes | None):
        def one(batches):
            lib, n = _libcrypto(), [0]
            held, digest = _hashed_on(lib, state, texts(batches, n))
            yield pa.RecordBatch.from_arrays([pa.array([n[0]], pa.int64()), pa.array([held]), pa.array([digest])], ["n", "state", "fingerprint"])

        return one

    def whole(batches):
        h, n = hashlib.sha256(), [0]
        for v in texts(batches, n):
            h.update(v)
        yield pa.RecordBatch.from_arrays([pa.array([n[0]], pa.int64()), pa.array([h.hexdigest()])], ["n", "fingerprint"])

    size = x.agg(F.coalesce(F.sum(F.octet_length("x") + F.octet_length(F.coalesce("k", F.lit(""))) + 16), F.lit(0)).alias("b")).first()["b"]
    parts = int(size) // DIGEST_BYTES + 1
    if parts == 1 or _libcrypto() is None:
        got = x.repartition(1).sortWithinPartitions("k").select("x").mapInArrow(whole, "n long, fingerprint string")
        # a task without rows may not run at all
        return got.agg(F.coalesce(F.max("n"), F.lit(0).cast("long")).alias("n"), F.coalesce(F.max("fingerprint"), F.lit(hashlib.sha256().hexdigest())).alias("fingerprint"))
    at = f"{shared_dir(spark)}/digest-{uuid.uuid4().hex}"
    x.repartitionByRange(parts, "k").withColumn("part", F.spark_partition_id()).write.partitionBy("part").parquet(at)
    state, n, digest = None, 0, hashlib.sha256().hexdigest()
    for part in sorted(r["part"] for r in spark.read.parquet(at).select("part").distinct().collect()):  # a row per part
        mine = spark.read.parquet(f"{at}/part={part}").coalesce(1).sortWithinPartitions("k").select("x")
        got = mine.mapInArrow(run(state), "n long, state binary, fingerprint string").first()
        state, n, digest = bytes(got["state"]), n + got["n"], got["fingerprint"]
    removed(spark, at)
    return spark.createDataFrame([(n, digest)], "n long, fingerprint string")
