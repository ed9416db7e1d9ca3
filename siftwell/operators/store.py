"""The store of authored descriptions: what applies, what is pending, what stays.

units: unit_id, path, qualified_name, hash, code_hash. entries: unit_id, path, name, hash,
code_hash, text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import glob_regex

from .snapshot import ordered_digest


def relocations(entries: DataFrame, digest: str = "hash") -> DataFrame:
    """(path, digest, ambiguous, text): what a moved unit may take over; ambiguous where
    entries of one path and digest differ in text, and then without one."""
    g = entries.where(F.col(digest).isNotNull()).groupBy("path", F.col(digest).alias("digest")).agg(F.count_distinct("text").alias("n"), F.min("text").alias("text"))
    return g.select("path", "digest", (F.col("n") > 1).alias("ambiguous"), F.when(F.col("n") == 1, F.col("text")).alias("text"))


def applicable(units: DataFrame, entries: DataFrame) -> DataFrame:
    """(unit_id, tier, text): the first of id and source, path and source, id and code,
    path and code. Later tiers only see the units that earlier ones leave."""
    out, left = None, units.select("unit_id", "path", "hash", "code_hash")
    for tier, (key, digest) in enumerate((("unit_id", "hash"), ("path", "hash"), ("unit_id", "code_hash"), ("path", "code_hash")), 1):
        if key == "unit_id":
            known = entries.where(F.col(digest).isNotNull()).select(F.col("unit_id").alias("_key"), F.col(digest).alias("_digest"), "text").dropDuplicates(["_key"])
        else:
            known = relocations(entries, digest).where("not ambiguous").select(F.col("path").alias("_key"), F.col("digest").alias("_digest"), "text")
        # named apart, as entries may come from the units themselves
        got = left.join(known, (F.col(key) == F.col("_key")) & (F.col(digest) == F.col("_digest"))).select("unit_id", F.lit(tier).cast("long").alias("tier"), "text")
        out = got if out is None else out.unionByName(got)
        left = left.join(got.select("unit_id"), "unit_id", "left_anti")
    return out


def states(units: DataFrame, entries: DataFrame) -> DataFrame:
    """(unit_id, path, qualified_name, state): described, superseded (an entry for the id,
    or for path and name, that no longer applies) or missing."""
    ok = applicable(units, entries).select("unit_id", F.lit(True).alias("ok"))
    by_id = entries.select("unit_id").distinct().withColumn("by_id", F.lit(True))
    by_name = entries.select("path", F.col("name").alias("qualified_name")).distinct().withColumn("by_name", F.lit(True))
    j = units.join(ok, "unit_id", "left").join(by_id, "unit_id", "left").join(by_name, ["path", "qualified_name"], "left")
    state = F.when(F.col("ok"), "described").when(F.col("by_id") | F.col("by_name"), "superseded").otherwise("missing")
    return j.select("unit_id", "path", "qualified_name", state.alias("state"))


def withheld(path, qualified_name, patterns: list[str]):
    """Whether a unit's path, or path::name, matches one of the skip patterns."""
    full = F.concat(path, F.lit("::"), qualified_name)
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(glob_regex(p)) | full.rlike(glob_regex(p))
    return out


def pending(units: DataFrame, entries: DataFrame, skip: list[str], limit: int) -> DataFrame:
    """(pos, unit_id, state): missing before superseded, in id order, without declined."""
    s = states(units, entries).where("state <> 'described'").where(~withheld(F.col("path"), F.col("qualified_name"), skip))
    ordered = s.orderBy(F.when(F.col("state") == "missing", 0).otherwise(1), "unit_id").limit(limit)
    w = Window.orderBy(F.when(F.col("state") == "missing", 0).otherwise(1), "unit_id")  # limit rows
    return ordered.select(F.row_number().over(w).cast("long").alias("pos"), "unit_id", "state")


def validated(items: DataFrame, units: DataFrame, max_chars: int) -> DataFrame:
    """(id, reason): items (id, unit_id, text) that can't be stored, and ``ok`` ones."""
    known = units.select("unit_id").withColumn("known", F.lit(True))
    j = items.join(known, "unit_id", "left")
    n = F.length(F.trim(F.coalesce("text", F.lit(""))))
    reason = (
        F.when(F.col("unit_id").isNull(), "not_an_object").when(F.col("known").isNull(), "unknown_unit").when(n == 0, "empty")
        .when(n > max_chars, F.concat(F.lit("too_long:"), n.cast("string"), F.lit(f"/{max_chars}"))).otherwise("ok")
    )
    return j.select("id", reason.alias("reason"))


def upserted(entries: DataFrame, new: DataFrame) -> DataFrame:
    """entries with those of new added or in the place of equal ids."""
    return entries.join(new.select("unit_id"), "unit_id", "left_anti").unionByName(new)


def pruned(entries: DataFrame, units: DataFrame) -> DataFrame:
    """(unit_id, kept): an entry stays if its id lives, or its path and source, or its
    path and code do."""
    ids = units.select("unit_id").distinct().withColumn("a", F.lit(True))
    src = units.select("path", "hash").distinct().withColumn("b", F.lit(True))
    code = units.select("path", "code_hash").distinct().withColumn("c", F.lit(True))
    j = entries.join(ids, "unit_id", "left").join(src, ["path", "hash"], "left").join(code, ["path", "code_hash"], "left")
    return j.select("unit_id", F.coalesce("a", "b", "c", F.lit(False)).alias("kept"))


def fingerprint(entries: DataFrame) -> DataFrame:
    """(fingerprint): a digest over ids, source digests and texts in id order; empty for an
    empty store."""
    c = ordered_digest(entries, "unit_id", F.concat("unit_id", F.coalesce("hash", F.lit("")), F.coalesce("text", F.lit(""))))
    return c.select(F.when(F.col("n") == 0, "").otherwise(F.col("fingerprint")).alias("fingerprint"))


def bootstrap_rung(counts: DataFrame, batch: int) -> DataFrame:
    """(action, remaining, rounds) from one row (remaining, promotable)."""
    action = F.when(F.col("remaining") > 0, "describe").when(F.col("promotable") > 0, "promote").otherwise("ready")
    return counts.select(action.alias("action"), "remaining", F.ceil(F.col("remaining") / max(batch, 1)).cast("long").alias("rounds"))
