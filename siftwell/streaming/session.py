"""Requests as JSON lines: one reply per line, never dying on a bad one.

Session answers line by line on the driver for interactive use; requests() and replies()
are the same over a stream of lines: a micro-batch of searches is one plan.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.config import Config, defaults
from siftwell.functions import embedders
from siftwell.operators import describe as W
from siftwell.operators import graph as G
from siftwell.operators import index as I
from siftwell.operators import ranking as R
from siftwell.operators import rebuild as B
from siftwell.operators import store as D
from siftwell.operators.durable import durable
from siftwell.sources import tree
from siftwell.sources.index_store import load
from siftwell.sources.tree import open_range

ACTIONS = ("search", "research", "neighbors", "open", "bootstrap", "describe_pending", "describe_put", "refresh", "stats")
REQUEST = "struct<id:string,action:string,query:string,limit:double,unit_id:string,hops:double,graph:boolean>"


def bounded(value, default: int, low: int, high: int) -> int:
    """A number of a request as a bounded integer; what isn't one becomes the default."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value != value:
        return default
    return int(max(low, min(high, value))) if not math.isinf(value) else (high if value > 0 else low)


class StaleMonitor:
    """Whether sources changed, asked at most once per ``every`` seconds; what can't be
    read counts as changed."""

    def __init__(self, changed: Callable[[], bool], every: float = 1.0, clock: Callable[[], float] = time.monotonic):
        self.changed, self.every, self.clock = changed, every, clock
        self.at, self.last = None, False

    def check(self) -> bool:
        now = self.clock()
        if self.at is None or now - self.at >= self.every:
            try:
                self.last = bool(self.changed())
            except OSError:
                self.last = True
            self.at = now
        return self.last


SHOWN = ("path", "language", "kind", "qualified_name", "signature", "start_line", "end_line", "description")


class Session:
    """index: units, postings, edges and, where there are any, vectors, files, meta (see
    index_store.load). With index_root it can be refreshed; root is the source tree.
    handlers: further actions, each a function of the request."""

    def __init__(
        self, spark: SparkSession, index: dict, root: str = ".", handlers: dict | None = None, monitor: StaleMonitor | None = None,
        cfg: Config | None = None, index_root: str | None = None,
    ):
        self.spark, self.root, self.monitor, self.cfg, self.index_root = spark, root, monitor, cfg or defaults(), index_root
        self.embedder = embedders.embedder(self.cfg)
        self.index_behind = False
        self._take(index)
        own = {a: getattr(self, a) for a in ACTIONS}
        self.handlers = own | (handlers or {})
        if monitor is None and "files" in index and "meta" in index:
            self.monitor = StaleMonitor(lambda: B.is_stale(self.spark, self.root, self.index["meta"], self.index["files"], self.cfg))

    def _take(self, index: dict) -> None:
        self.index = index
        self.n = index["units"].agg(F.count("*").alias("n"))
        self.entries = W.read_store(self.spark, self.root)

    def reply(self, line: str) -> dict:
        try:
            request = json.loads(line)
        except ValueError:
            return {"error": "invalid_json"}
        if not isinstance(request, dict) or not isinstance(request.get("action", ""), str):
            return {"error": "invalid_request"}
        return self.answer(request)

    def answer(self, request: dict) -> dict:
        action = request.get("action", "search")
        if action not in self.handlers:
            out: dict = {"error": f"unsupported action: {action}"}
        else:
            try:
                out = dict(self.handlers[action](request))
            except Exception as e:  # the loop must go on
                bad = isinstance(e, (TypeError, ValueError))
                out = {"error": "invalid_request" if bad else "request_failed", "type": type(e).__name__, "message": f"{type(e).__name__}: {e}"[:500]}
        if self.monitor is not None and "stale" not in out:
            out["stale"] = self.monitor.check()
        out.setdefault("degraded", self.index.get("degraded"))
        return out

    # searches

    def _query(self, request: dict) -> DataFrame:
        if not isinstance(request.get("query", ""), str):
            raise ValueError("query must be a string")
        return self.spark.createDataFrame([(0, request.get("query", ""))], "query_id long, query string")

    def _ranked(self, request: dict, limit: int):
        """(evidence row, term states, winners as rows of query_id, rank, unit_id, score, the
        probe) of one question."""
        q = self._query(request)
        at = R.probe(q, self.index["postings"])
        bars = self.cfg["search.min_coverage"], self.cfg["search.min_concentration"]
        ev = R.evidence(q, at, self.n, *bars).first().asDict()
        states = R.term_states(at, self.n).orderBy("term").collect()  # the question's terms
        if not ev["sufficient"] or limit <= 0:
            return ev, states, None, at
        if self.index.get("vectors") is not None:
            v = self.embedder.transform(q.select(F.lit("q").alias("unit_id"), F.col("query").alias("text")))
            qv = v.select(F.lit(0).cast("long").alias("query_id"), F.col("vector").alias("query_vector"))
            uv = self.index["vectors"].select("unit_id", F.col("vector").cast("array<double>").alias("unit_vector"))
            scores = R.hybrid(q, at, self.n, uv, qv, self.cfg["search.vector_weight"], self.embedder.semantic and self.cfg["search.vector_recall"] > 0, self.cfg["search.vector_recall"], *bars)
        else:
            scores = at.lexical(self.n).withColumnRenamed("lexical", "score")
        return ev, states, durable(R.ranked(scores, limit)), at

    def _diagnosis(self, ev: dict, states: list) -> dict:
        """Why there is no answer, and what helps."""
        n = states[0]["n"] if states else self.n.first()["n"]
        scale = min(1.0, n / R.FULL_SIZE)
        of = lambda *kinds: [r["term"] for r in states if r["state"] in kinds]
        bars = {k: self.cfg[f"search.{k}"] for k in ("min_coverage", "min_concentration")}
        return {
            "reason": ev["reason"], "query_terms": ev["query_terms"], "distinctive_terms": of("matched", "absent"), "matched_terms": of("matched"),
            "ubiquitous_terms": of("ubiquitous"), "coverage": round(ev["coverage"], 4), "concentration": round(ev["concentration"], 4),
            **bars, **{f"applied_{k}": round(v * scale, 4) for k, v in bars.items()}, "hint": R.HINTS.get(ev["reason"], ""),
        }

    def _shown(self, winners: DataFrame, at, max_chars: int) -> tuple[list[dict], str, int]:
        """(results, context, how many did not fit it) of winners (query_id, rank, unit_id,
        score, and via_graph or path)."""
        words = R.matched_terms(winners, at).select("unit_id", "terms") if at is not None else None
        j = winners.join(self.index["units"].select("unit_id", *[c for c in SHOWN if c in self.index["units"].columns], "source"), "unit_id")
        j = j.join(words, "unit_id", "left") if words is not None else j.withColumn("terms", F.lit(None).cast("string"))
        rows = [r.asDict() for r in j.orderBy("rank").collect()]  # limit rows
        blocks, used, out = [], 0, []
        for r in rows:
            evidence = ["graph"] if r.get("via_graph") else []
            out.append({"id": r["unit_id"], "score": r["score"], "matched_terms": (r["terms"] or "").split(), "evidence": evidence} | {k: r[k] for k in SHOWN if k in r})
            block = f"{r.get('path')}:{r.get('start_line')} (score {r['score']:.3f})\n{r.get('description')}\n{r['source']}"
            used += len(block) + 2
            if used <= max_chars or not blocks:
                blocks.append(block[:max_chars])
            else:
                used = max_chars + 1  # nothing behind what did not fit
        return out, "\n\n".join(blocks)[:max_chars], len(rows) - len(blocks)

    def _bound(self, request: dict, name: str, default, low: int, high: int) -> int:
        return bounded(request.get(name), default, low, high)

    def search(self, request: dict) -> dict:
        limit = self._bound(request, "limit", self.cfg["search.limit"], 0, 100)
        hops = self._bound(request, "hops", 1, 0, 3)
        budget = self._bound(request, "max_chars", self.cfg["search.max_chars"], 0, 100_000)
        graph = bool(request.get("graph", False))
        ev, states, top, at = self._ranked(request, max(2 * limit, 8) if graph and limit else limit)
        if top is None:
            return {"results": [], "omitted_for_budget": 0, "context": "", "diagnosis": self._diagnosis(ev, states)}
        if graph:
            top = durable(G.graph_search(top, self.index["edges"], limit, hops) if hops else top.where(F.col("rank") <= limit))
        results, context, omitted = self._shown(top, at, budget)
        return {"results": results, "omitted_for_budget": omitted, "context": context, "diagnosis": None if results else self._diagnosis(ev, states)}

    def research(self, request: dict) -> dict:
        limit = self._bound(request, "limit", self.cfg["search.limit"], 0, 100)
        budget = self._bound(request, "max_chars", self.cfg["search.max_chars"], 0, 100_000)
        steps, bar = self._bound(request, "max_steps", 2, 1, 2), float(request.get("dominance_threshold", 0.30))
        ev, states, seeds, at = self._ranked(request, max(1, limit))
        trace = lambda rows: [{"id": r["id"], "score": r["score"], "matched_terms": r["matched_terms"]} for r in rows]
        said = {"query": request.get("query", "")}
        if seeds is None or seeds.isEmpty():
            return said | {"results": [], "steps": [{"action": "search", "results": []}], "stop_reason": "no_results", "context": "", "diagnosis": self._diagnosis(ev, states)}
        first, _, _ = self._shown(seeds, at, 0)
        done = [{"action": "search", "query": said["query"], "results": trace(first)}]
        hops = self._bound(request, "hops", 1, 0, 3)
        got = durable(G.research(seeds, self.index["edges"], max(1, limit), steps, bar, hops) if limit else seeds.withColumn("stop_reason", F.lit("high_confidence")).where("false"))
        reason = got.select("stop_reason").first()
        results, context, _ = self._shown(got, at, budget)
        if reason and reason[0] != "high_confidence":
            done.append({"action": "graph_expand", "hops": hops, "results": trace(results)})
        return said | {"results": results, "steps": done, "stop_reason": reason[0] if reason else "no_results", "context": context}

    def neighbors(self, request: dict) -> dict:
        unit = str(request.get("id", request.get("unit_id", "")))
        start = self.spark.createDataFrame([(unit,)], "start_id string")
        hops, limit = self._bound(request, "hops", 1, 0, 3), self._bound(request, "limit", self.cfg["search.limit"], 0, 100)
        rows = G.neighbors(self.index["edges"], start, hops, str(request.get("direction", "both")))
        got = rows.orderBy("hop", "rank").limit(limit).collect()
        if not got:
            return {"id": unit, "neighbors": [], "results": [], "context": ""}
        top = self.spark.createDataFrame([(0, i, r["unit_id"], 0.0) for i, r in enumerate(got, 1)], "query_id long, rank long, unit_id string, score double")
        shown, context, _ = self._shown(top, None, self._bound(request, "max_chars", self.cfg["search.max_chars"], 0, 100_000))
        units = {x["id"]: {k: x[k] for k in ("id", *SHOWN) if k in x} for x in shown}
        return {"id": unit, "neighbors": [{"path": r["path"], "unit": units.get(r["unit_id"], {"id": r["unit_id"]})} for r in got], "results": [{"id": r["unit_id"], "path": r["path"]} for r in got], "context": context}

    def open(self, request: dict) -> dict:
        return open_range(self.root, str(request.get("path", "")), request.get("start_line"), request.get("end_line"), self.cfg["agent.max_open_bytes"], self.cfg["agent.max_open_chars"])

    # descriptions

    def _live(self) -> DataFrame:
        """The units as the description workflow needs them."""
        u = self.index["units"]
        if "generated" not in u.columns:
            u = u.withColumn("generated", F.col("description"))
        return u if "code_hash" in u.columns else W.keyed(u)

    def _files(self) -> DataFrame:
        return tree.read_tree(self.spark, self.root, self.cfg).select("path", "content")

    def bootstrap(self, request: dict) -> dict:
        limit = self._bound(request, "limit", self.cfg["describe.batch"], 0, 200)
        report = {"indexed_units": self.n.first()["n"], "graph_edges": self.index["edges"].count()}
        return W.bootstrap(self._live(), self.entries, self._files(), self.cfg, report, limit)

    def describe_pending(self, request: dict) -> dict:
        return W.batch(self._live(), self.entries, self.cfg, self._bound(request, "limit", self.cfg["describe.batch"], 0, 200))

    def describe_put(self, request: dict) -> dict:
        """Stores descriptions and applies them to the live units, so that the next search
        already finds them; the published index waits for a refresh."""
        live = self._live()
        after, report = W.put(live, self.entries, self.cfg, request.get("descriptions", []))
        report |= {"applied": 0, "path": f"{self.root}/{W.STORE}"}
        if report["stored"]:
            self.entries = durable(after)
            W.write_store(self.entries, self.root)
            units = durable(W.applied(live, self.entries).select(*live.columns))
            was = live.select("unit_id", F.col("description").alias("was"))
            changed = durable(units.join(was, "unit_id").where("description <> was").drop("was"))
            report["applied"] = changed.count()
            if self.index.get("vectors") is not None and "serial" in units.columns:
                new = self.embedder.transform(B.embedding_texts(changed).select("unit_id", "text"))
                old = self.index["vectors"].select("unit_id", "vector").join(changed.select("unit_id"), "unit_id", "left_anti")
                self.index = self.index | {"vectors": durable(old.unionByName(new.select("unit_id", F.col("vector").cast("array<float>").alias("vector"))))}
            self.index = self.index | {"units": units, "postings": durable(I.postings(units))}
            self.index_behind = True
        report["remaining"] = W.status(self._live(), self.entries, self.cfg["describe.skip"])["remaining"]
        return report

    def refresh(self, request: dict) -> dict:
        if self.index_root is None:
            raise ValueError("this session has no index that it may write")
        report = B.refresh(self.spark, self.root, self.index_root, self.cfg, bool(request.get("full", False)))
        self._take(load(self.spark, self.index_root))
        self.index_behind = False
        if self.monitor is not None:
            self.monitor.at = None
        return report

    def stats(self, request: dict) -> dict:
        u = self.index["units"].agg(F.count("*").alias("units"), F.count_distinct("path").alias("files")).first()
        out = {"units": u["units"], "files": u["files"], "edges": self.index["edges"].count(), "index_behind": self.index_behind}
        out["warnings"] = self.index["diagnostics"].count() if "diagnostics" in self.index else 0
        out["embedding"] = self.index.get("meta", {}).get("embedding")
        out["described"] = D.applicable(self._live(), self.entries).count()
        if self.monitor is not None:
            self.monitor.at = None  # asked for: look now
        return out


def requests(lines: DataFrame) -> DataFrame:
    """lines (value) as value, id, action (search where none is given), query, limit,
    unit_id, hops, graph, error: batch or stream."""
    r = F.from_json("value", REQUEST, {"mode": "PERMISSIVE"}).alias("r")
    j = lines.select("value", r, F.try_parse_json("value").isNull().alias("bad"))
    other = ~F.startswith(F.ltrim("value"), F.lit("{"))
    action = F.when(~other, F.coalesce("r.action", F.lit("search")))
    j = j.withColumn("r", F.col("r").withField("action", action))
    error = F.when(F.col("bad"), "invalid_json").when(F.col("r.action").isNull(), "invalid_request").when(~F.col("r.action").isin(*ACTIONS), F.concat(F.lit("unsupported action: "), "r.action"))
    return j.select("value", "r.*", error.alias("error"))


def replies(batch: DataFrame, index: dict, limit: int = R.LIMIT) -> DataFrame:
    """(id, error, diagnosis, results) of a micro-batch: all its searches in one plan.
    Requests of other actions have null results here; serve() answers them."""
    r = requests(batch).withColumn("query_id", F.xxhash64("id", "query"))
    q = r.where("error is null and action = 'search' and query is not null").select("query_id", "query").distinct()
    n = index["units"].agg(F.count("*").alias("n"))
    at = R.probe(q, index["postings"])
    ev = durable(R.evidence(q, at, n))
    scores = at.lexical(n).join(ev.where("sufficient").select("query_id"), "query_id", "left_semi").withColumnRenamed("lexical", "score")
    top = R.ranked(scores, limit).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "unit_id", "score"))).alias("results"))
    j = r.join(ev.select("query_id", "reason"), "query_id", "left").join(top, "query_id", "left")
    return j.select("id", "error", F.when(F.col("reason") != "", F.col("reason")).alias("diagnosis"), F.to_json("results").alias("results"))


def serve(lines: DataFrame, index: dict, out: str, checkpoint: str, session: Session | None = None):
    """Answers a stream of request lines into Parquet at out, one folder per micro-batch
    that a repeated batch overwrites. Searches are one plan; with a session, every other
    action is answered by it, in the order of the lines."""

    def one(batch: DataFrame, number: int) -> None:
        to = f"{out}/batch={number}"
        if session is None:
            replies(batch, index).write.mode("overwrite").parquet(to)
            return
        plain = (F.col("action") == "search") & ~F.coalesce(F.col("graph"), F.lit(False))
        batch = batch.select("value").persist()
        try:
            told = requests(batch)
            # the requests that one session answers, few against the searches
            rest = [r["value"] for r in told.where(F.col("error").isNull() & ~plain).select("value").collect()]
            own = batch.sparkSession.createDataFrame([(json.loads(x).get("id"), json.dumps(session.reply(x), ensure_ascii=False, default=str)) for x in rest], "id string, reply string")
            searched = replies(told.where(F.col("error").isNotNull() | plain).select("value"), session.index)
            searched.withColumn("reply", F.lit(None).cast("string")).unionByName(own, allowMissingColumns=True).write.mode("overwrite").parquet(to)
        finally:
            batch.unpersist()

    return lines.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
