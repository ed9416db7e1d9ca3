"""Edges between units, bounded traversal and score propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable
from .ranking import small

EDGE_BUDGET = 64
DECAY = {"calls": 0.7, "contains": 0.5, "imports": 0.3}
OTHER_DECAY = 0.4
MAX_HOPS = 3
EDGE = "struct<source:string,target:string,kind:string,label:string>"


def from_json(lines: DataFrame, column: str = "line") -> DataFrame:
    """Edges of JSON objects; what isn't one, or lacks an end or a kind, is left out, and
    so is an edge to itself."""
    j = lines.select(F.from_json(column, EDGE).alias("e")).select("e.*")
    j = j.where("source is not null and target is not null and kind is not null and source <> target")
    return j.select("source", "target", "kind", F.coalesce("label", F.lit("")).alias("label")).dropDuplicates()


def valid(edges: DataFrame, units: DataFrame) -> DataFrame:
    """Distinct edges with both ends among units."""
    ids = units.select("unit_id")
    e = edges.dropDuplicates(["source", "target", "kind", "label"])
    e = e.join(ids.withColumnRenamed("unit_id", "source"), "source", "left_semi")
    return e.join(ids.withColumnRenamed("unit_id", "target"), "target", "left_semi").select("source", "target", "kind", "label")


def names(units: DataFrame) -> DataFrame:
    """(key, unit_id, path): every unit under its name and, where it differs, its
    qualified name."""
    both = F.array_distinct(F.array("name", "qualified_name"))
    return units.select(F.explode(both).alias("key"), "unit_id", "path")


def contains_edges(units: DataFrame) -> DataFrame:
    """Parent names resolved: unique in the same file, else unique everywhere."""
    u = units.where("parent is not null and parent <> ''").select(F.col("unit_id").alias("target"), "parent", F.col("path").alias("own"))
    n = names(units)
    # counts per name are aggregated first, so a common name isn't paired with itself
    everywhere = n.groupBy("key").agg(F.count("*").alias("n_all"), F.min("unit_id").alias("one_all"))
    here = n.groupBy("key", "path").agg(F.count("*").alias("n_here"), F.min("unit_id").alias("one_here"))
    j = u.join(everywhere, u["parent"] == everywhere["key"]).drop("key")
    j = j.join(here, (j["parent"] == here["key"]) & (j["own"] == here["path"]), "left")
    owner = F.when(F.col("n_here") == 1, F.col("one_here")).when(F.col("n_all") == 1, F.col("one_all"))
    j = j.select(owner.alias("source"), "target", F.lit("contains").alias("kind"), F.col("parent").alias("label"))
    return j.where("source is not null and source <> target")


def call_edges(units: DataFrame, stems: DataFrame | None = None) -> DataFrame:
    """(source, target, kind, label, pos) of resolved calls. A dotted call falls back to
    its last part if its head is self or cls (then in the same file) or a module that a
    file of units bears the name of. Same file unique first, then unique everywhere."""
    from siftwell.functions.text import module_stem

    calls = units.select("unit_id", F.col("path").alias("own"), F.posexplode("calls").alias("pos", "call"))
    n = names(units)
    exact = n.select("key").distinct().withColumn("exact", F.lit(True))
    j = calls.join(exact, calls["call"] == exact["key"], "left").drop("key")
    head, leaf = F.substring_index("call", ".", 1), F.substring_index("call", ".", -1)
    modules = stems if stems is not None else units.select(module_stem(F.col("path")).alias("stem")).distinct()
    j = j.withColumn("head", head).join(modules.withColumnRenamed("stem", "head").withColumn("local", F.lit(True)), "head", "left")
    dotted = F.col("call").contains(".")
    own = F.col("head").isin("self", "cls")
    key = F.when(F.col("exact"), F.col("call")).when(dotted & (own | F.col("local")), leaf)
    j = j.select("unit_id", "own", "pos", "call", key.alias("key"), (F.col("exact").isNull() & own).alias("own_only")).where("key is not null")
    everywhere = n.groupBy("key").agg(F.count("*").alias("n_all"), F.min("unit_id").alias("low"), F.max("unit_id").alias("high"))
    here = n.groupBy("key", F.col("path").alias("own")).agg(F.count("*").alias("n_here"), F.min("unit_id").alias("low_here"), F.max("unit_id").alias("high_here"))
    j = j.join(everywhere, "key").join(here, ["key", "own"], "left")
    me = (F.col("unit_id") == F.col("low_here")) | (F.col("unit_id") == F.col("high_here"))
    # the caller itself doesn't count among the candidates of its file
    others = F.coalesce("n_here", F.lit(0)) - F.when(me & (F.col("n_here") <= 2), 1).otherwise(0)
    other = F.when(F.col("low_here") == F.col("unit_id"), F.col("high_here")).otherwise(F.col("low_here"))
    target = F.when(others == 1, other).when(~F.col("own_only") & (F.col("n_all") == 1), F.col("low"))
    j = j.select(F.col("unit_id").alias("source"), target.alias("target"), F.lit("calls").alias("kind"), F.col("call").alias("label"), "pos")
    return j.where("target is not null and target <> source")


def import_edges(units: DataFrame) -> DataFrame:
    """(source, target, kind, label, pos): imported modules that exactly one file of at
    most three units bears the name of."""
    from siftwell.functions.text import module_stem

    imports = units.select("unit_id", F.posexplode("imports").alias("pos", "label")).withColumn("stem", F.substring_index("label", ".", -1))
    m = units.select(module_stem(F.col("path")).alias("stem"), "path", "unit_id")
    small = m.groupBy("stem").agg(F.count("*").alias("n"), F.count_distinct("path").alias("files")).where("n <= 3 and files = 1").select("stem")
    t = m.join(small, "stem", "left_semi").select("stem", F.col("unit_id").alias("target"))
    j = imports.join(t, "stem").where("target <> unit_id")
    return j.select(F.col("unit_id").alias("source"), "target", F.lit("imports").alias("kind"), "label", "pos")


def budgeted(edges: DataFrame, budget: int = EDGE_BUDGET) -> DataFrame:
    """At most ``budget`` edges per source in the order parents, calls, imports, place;
    edges: source, target, kind, label, pos, charged_to. A repeated edge is charged too."""
    phase = F.when(F.col("kind") == "contains", 0).when(F.col("kind") == "calls", 1).otherwise(2)
    w = Window.partitionBy("charged_to").orderBy(phase, "pos", "target")
    kept = edges.withColumn("rn", F.row_number().over(w)).where((F.col("rn") <= budget) | (F.col("kind") == "contains"))
    return kept.select("source", "target", "kind", "label").dropDuplicates()


def build(units: DataFrame, budget: int = EDGE_BUDGET) -> DataFrame:
    """All edges of units (unit_id, path, name, qualified_name, parent, calls, imports)."""
    parents = contains_edges(units).select("*", F.lit(0).alias("pos"), F.col("target").alias("charged_to"))
    calls = call_edges(units).withColumn("charged_to", F.col("source"))
    imports = import_edges(units).withColumn("charged_to", F.col("source"))
    return budgeted(parents.unionByName(calls).unionByName(imports), budget)


def decay(kind):
    """The weight of an edge of a kind."""
    w = F.lit(OTHER_DECAY)
    for k, v in DECAY.items():
        w = F.when(kind == k, v).otherwise(w)
    return w


def neighbors(edges: DataFrame, starts: DataFrame, hops: int = 1, direction: str = "both", units: DataFrame | None = None) -> DataFrame:
    """(start_id, hop, rank, unit_id, path, weight) breadth first from starts (start_id):
    each node once, by the first path that reaches it in edge order; weight is the product
    of that path's decays. With units (unit_id, each once), edges to anything else are
    passed over, so that edges need no check of their own: only what a hop reaches is looked
    up. At most MAX_HOPS; each hop is written before the next one, whose join it decides: a
    front of checked size goes to the edges, which then don't move."""
    if direction not in ("out", "in", "both"):
        raise ValueError(f"direction must be out, in or both, got {direction!r}")
    step = F.concat(F.col("kind"), F.lit(":"), "source", F.lit("->"), "target").alias("step")
    out = edges.select(F.col("source").alias("at"), F.lit(0).alias("dir"), F.col("kind").alias("k1"), F.col("target").alias("k2"), step, decay(F.col("kind")).alias("w"), F.col("target").alias("to"))
    into = edges.select(F.col("target").alias("at"), F.lit(1).alias("dir"), F.col("source").alias("k1"), F.col("kind").alias("k2"), step, decay(F.col("kind")).alias("w"), F.col("source").alias("to"))
    walk = out if direction == "out" else into if direction == "in" else out.unionByName(into)

    def known(df: DataFrame, column: str) -> DataFrame:
        if units is None:
            return df
        return units.select(F.col("unit_id").alias(column)).join(small(df), column).select(*df.columns)

    starts = durable(known(starts.select("start_id").distinct(), "start_id"))
    front = starts.select("start_id", F.col("start_id").alias("unit_id"), F.lit(0).cast("long").alias("rank"), F.col("start_id").alias("path"), F.lit(1.0).alias("weight"))
    seen = front.select("start_id", "unit_id")
    found = None
    for hop in range(1, min(hops, MAX_HOPS) + 1):
        at = front.select("start_id", F.col("unit_id").alias("at"), F.col("rank").alias("parent"), "path", "weight")
        c = walk.join(small(at), "at").select("start_id", F.col("to").alias("unit_id"), "parent", "dir", "k1", "k2", F.concat_ws(" ", "path", "step", "to").alias("path"), (F.col("weight") * F.col("w")).alias("weight"))
        c = c.join(seen, ["start_id", "unit_id"], "left_anti")
        # partial aggregation keeps the first path per node before anything is ranked; of a
        # repeated edge as well
        first = durable(c.groupBy("start_id", "unit_id").agg(F.min(F.struct("parent", "dir", "k1", "k2", "path", "weight")).alias("m")))
        w = Window.partitionBy("start_id").orderBy("m.parent", "m.dir", "m.k1", "m.k2", "unit_id")
        front = durable(known(first, "unit_id").select("start_id", "unit_id", F.row_number().over(w).cast("long").alias("rank"), F.col("m.path").alias("path"), F.col("m.weight").alias("weight")))
        seen = seen.unionByName(front.select("start_id", "unit_id"))
        got = front.select("start_id", F.lit(hop).cast("long").alias("hop"), "rank", "unit_id", "path", "weight")
        found = got if found is None else found.unionByName(got)
    if found is None:
        return front.select("start_id", F.lit(0).cast("long").alias("hop"), "rank", "unit_id", "path", "weight").where("false")
    return found


def graph_search(seeds: DataFrame, edges: DataFrame, limit: int, hops: int = 1, units: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, unit_id, score, via_graph): seeds (query_id, unit_id, score) and
    what they lead to, each at the best of its own and its propagated scores."""
    starts = seeds.select(F.col("unit_id").alias("start_id")).distinct()
    paths = neighbors(edges, starts, hops, units=units)
    reached = seeds.join(paths.select("start_id", F.col("unit_id").alias("to"), "weight"), seeds["unit_id"] == F.col("start_id"))
    via = reached.select("query_id", F.col("to").alias("unit_id"), (F.col("score") * F.col("weight")).alias("score"), F.lit(1).alias("graph"))
    own = seeds.select("query_id", "unit_id", "score", F.lit(0).alias("graph"))
    # only a strictly better propagated score replaces a seed's own
    best = own.unionByName(via).groupBy("query_id", "unit_id").agg(F.max(F.struct("score", (-F.col("graph")).alias("g"))).alias("m"))
    s = best.select("query_id", "unit_id", F.round("m.score", 6).alias("score"), (F.col("m.g") < 0).alias("via_graph"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("unit_id"))
    return s.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= limit).select("query_id", "rank", "unit_id", "score", "via_graph")


def research(seeds: DataFrame, edges: DataFrame, limit: int, max_steps: int = 2, bar: float = 0.30, hops: int = 1, units: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, unit_id, score, stop_reason): a dominant first result ends the
    search; otherwise the graph's results are merged in. seeds also have rank."""
    from .ranking import dominance

    d = dominance(seeds)
    sure = (F.col("dominance") >= bar) if max_steps > 1 else F.lit(True)
    d = d.select("query_id", sure.alias("sure"))
    firm = seeds.join(d.where("sure"), "query_id", "left_semi").where(F.col("rank") <= limit)
    open_ = seeds.join(d.where("not sure"), "query_id", "left_semi").select("query_id", "unit_id", "score")
    more = durable(graph_search(open_, edges, max(2 * limit, 8), hops, units))
    merged = open_.select("query_id", "unit_id", "score", F.lit(0).alias("o")).unionByName(more.select("query_id", "unit_id", "score", F.lit(1).alias("o")))
    one = merged.groupBy("query_id", "unit_id").agg(F.max(F.struct("score", (-F.col("o")).alias("o"))).alias("m")).select("query_id", "unit_id", "m.score")
    new = more.join(open_, ["query_id", "unit_id"], "left_anti").select("query_id").distinct().withColumn("new", F.lit(True))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("unit_id"))
    rest = one.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= limit).join(new, "query_id", "left")
    rest = rest.select("query_id", "rank", "unit_id", "score", F.when(F.col("new"), "new_graph_evidence").otherwise("no_new_evidence").alias("stop_reason"))
    return firm.select("query_id", "rank", "unit_id", "score", F.lit("high_confidence").alias("stop_reason")).unionByName(rest)
