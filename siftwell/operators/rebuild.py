"""Building and rebuilding a published index of a source tree.

Files whose content is unchanged keep their units; the others are parsed. Serials stay with
their units, vectors stay where text, width and serial do, and authored descriptions are
applied anew each time. Another configuration, parser or embedder makes the previous index
one of something else, of which nothing is kept.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.config import Config
from siftwell.functions import embedders, parse
from siftwell.sources import index_store, tree

from . import corpus as C
from . import describe as W
from . import graph as G
from . import snapshot as S
from . import store as D
from .durable import durable


def build_fingerprint(cfg: Config) -> str:
    """A digest of what decides what a unit is: the settings and the parser."""
    with open(parse.__file__, "rb") as f:
        own = hashlib.sha256(f.read()).hexdigest()
    return hashlib.sha256(f"{cfg.build_fingerprint()}:{own}".encode()).hexdigest()


def marked(description, serial, unit_id):
    """The comment line that names a unit."""
    return F.format_string("RAG[%05d] %s: %s", serial, unit_id, description)


def embedding_texts(units: DataFrame) -> DataFrame:
    """(unit_id, serial, text): what a unit's vector is made of."""
    text = F.concat(marked(F.col("description"), F.col("serial"), F.col("unit_id")), F.lit("\n"), C.searchable_text())
    return C.fields(units).select("unit_id", "serial", text.alias("text"))


def refresh(spark: SparkSession, root: str, index: str, cfg: Config, full: bool = False) -> dict:
    """Publishes an index of the tree at root under index, and reports on it."""
    e = embedders.embedder(cfg)
    build = build_fingerprint(cfg)
    previous = None
    if not full:
        try:
            previous = index_store.load(spark, index)
        except (OSError, ValueError):
            previous = None
    changed = previous is not None and previous["meta"]["build_fingerprint"] != build
    if changed:
        previous = None
    now = durable(tree.read_tree(spark, root, cfg).drop("content"))
    if previous is None:
        kept, todo = None, now.select("path")
    else:
        split = S.incremental_split(previous["files"], now)
        had = previous["units"].select("path").unionByName(previous["diagnostics"].select("path")).distinct()
        todo = split.where("action = 'parse'").select("path").unionByName(split.where("action = 'reuse'").select("path").join(had, "path", "left_anti"))
        todo = durable(todo)
        same = now.select("path").join(todo, "path", "left_anti")
        kept = previous["units"].join(same, "path", "left_semi")
    # what is parsed says itself what content that was: a file may change between two looks
    read = durable(tree.read_tree(spark, root, cfg).join(todo, "path", "left_semi"))
    parsed = durable(parse.parse_files(read))
    fresh = W.keyed(parse.units_of(parsed).withColumnRenamed("description", "generated"))
    names = fresh.columns
    units = fresh if kept is None else fresh.unionByName(kept.select(*names))
    files = now.join(todo, "path", "left_anti").unionByName(read.drop("content"))
    notes = parse.diagnostics_of(parsed)
    if previous is not None:
        notes = notes.unionByName(previous["diagnostics"].join(todo, "path", "left_anti").join(now.select("path"), "path", "left_semi"))
    entries = durable(W.read_store(spark, root))
    before = previous["units"].select("unit_id", "serial") if previous is not None else spark.createDataFrame([], "unit_id string, serial long")
    units = durable(units)
    units = W.applied(units, entries).join(S.stable_serials(units, before), "unit_id")
    units = durable(units)
    texts = durable(embedding_texts(units).withColumn("text_sha", S.digest(F.col("text"))).withColumn("width", F.lit(e.dimensions)))
    reused = None
    if previous is not None and previous["meta"].get("embedding") == embedders.described(e) and previous["degraded"] is None:
        old = previous["vectors"]
        keep = S.vector_reuse(texts, old.select("unit_id", "text_sha", F.size("vector").alias("width"), "serial")).where("reused").select("unit_id")
        reused = old.join(keep, "unit_id", "left_semi").select("unit_id", "vector")
        fresh_texts = texts.join(keep, "unit_id", "left_anti")
    else:
        fresh_texts = texts
    vectors = e.transform(fresh_texts.select("unit_id", "text")).select("unit_id", F.col("vector").cast("array<float>").alias("vector"))
    if reused is not None:
        vectors = vectors.unionByName(reused)
    vectors = vectors.join(texts.select("unit_id", "text_sha", "serial"), "unit_id")
    edges = durable(G.build(units))
    stamp = S.ordered_digest(files.select("path", "sha256"), "path", F.concat("path", "sha256")).first()
    meta = {
        "fingerprint": stamp["fingerprint"], "build_fingerprint": build, "descriptions_fingerprint": D.fingerprint(entries).first()["fingerprint"],
        "dimensions": e.dimensions, "embedding": embedders.described(e), "root": os.path.abspath(root),
    }
    index_store.publish(index, units, edges, vectors, meta, {"files": files.select("path", "size", "mtime_ns", "sha256"), "diagnostics": notes})
    counts = W.status(units, entries, ())
    return {
        "indexed_units": units.count(), "graph_edges": edges.count(), "warnings": notes.count(), "incremental": previous is not None, "rebuilt_for_inputs": changed,
        "parsed_files": todo.count(), "described": counts["described"], "pending_descriptions": counts["superseded"] + counts["missing"], "index": index, "root": root,
    }


def is_stale(spark: SparkSession, root: str, meta: dict, files: DataFrame, cfg: Config) -> bool:
    """Whether files, settings, parser or descriptions differ from what an index was made
    of. Files are compared by size and time of change, so none is read."""
    if meta["build_fingerprint"] != build_fingerprint(cfg):
        return True
    if meta["descriptions_fingerprint"] != D.fingerprint(W.read_store(spark, root)).first()["fingerprint"]:
        return True
    stat = F.concat_ws(":", "size", "mtime_ns").alias("stat")
    now = tree.read_tree(spark, root, cfg, content=False).select("path", stat)
    return not S.stale_diff(files.select("path", stat), now).isEmpty()
