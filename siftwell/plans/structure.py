"""Queries of the graph, line, incremental, store and evaluation families."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.operators import corpus as C
from siftwell.operators import evaluate as E
from siftwell.operators import graph as G
from siftwell.operators import lines as L
from siftwell.operators import ranking as R
from siftwell.operators import snapshot as S
from siftwell.operators import store as D
from siftwell.operators.durable import durable

from . import retrieval as V
from .sqlkit import QUERY, RANK, UNITS

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# graph: regions contain nations contain customers and suppliers, orders call customers,
# line items import parts

EDGES = """edges AS (
  SELECT 'region:' || n_regionkey AS source, 'nation:' || n_nationkey AS target, 'contains' AS kind, n_name AS label FROM nation
  UNION SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'contains', c_name FROM customer
  UNION SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'contains', s_name FROM supplier
  UNION SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'calls', o_orderstatus FROM orders
  UNION SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'imports', l_linestatus FROM lineitem),
ids AS (SELECT 'region:' || r_regionkey AS unit_id FROM region UNION ALL SELECT 'nation:' || n_nationkey FROM nation UNION ALL SELECT 'customer:' || c_custkey FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier UNION ALL SELECT 'order:' || o_orderkey FROM orders UNION ALL SELECT 'part:' || p_partkey FROM part),
valid AS (SELECT e.* FROM edges e SEMI JOIN ids a ON a.unit_id = e.source SEMI JOIN ids b ON b.unit_id = e.target)"""


def _id(kind: str, col: str):
    return F.concat(F.lit(f"{kind}:"), F.col(col).cast("string"))


def _edges(s, d):
    def one(table, source, target, kind, label):
        return C.table(s, d, table).select(source.alias("source"), target.alias("target"), F.lit(kind).alias("kind"), F.col(label).alias("label"))

    return (
        one("nation", _id("region", "n_regionkey"), _id("nation", "n_nationkey"), "contains", "n_name")
        .unionByName(one("customer", _id("nation", "c_nationkey"), _id("customer", "c_custkey"), "contains", "c_name"))
        .unionByName(one("supplier", _id("nation", "s_nationkey"), _id("supplier", "s_suppkey"), "contains", "s_name"))
        .unionByName(one("orders", _id("order", "o_orderkey"), _id("customer", "o_custkey"), "calls", "o_orderstatus"))
        .unionByName(one("lineitem", _id("order", "l_orderkey"), _id("part", "l_partkey"), "imports", "l_linestatus"))
    )


def _ids(s, d):
    out = None
    for table, kind, col in (("region", "region", "r_regionkey"), ("nation", "nation", "n_nationkey"), ("customer", "customer", "c_custkey"), ("supplier", "supplier", "s_suppkey"), ("orders", "order", "o_orderkey"), ("part", "part", "p_partkey")):
        one = C.table(s, d, table).select(_id(kind, col).alias("unit_id"))
        out = one if out is None else out.unionByName(one)
    return out


@query("edges_valid", f"WITH {EDGES} SELECT source, target, kind, label FROM valid")
def edges_valid(s, d):
    return G.valid(_edges(s, d), _ids(s, d))


@query(
    "edges_from_json",
    """SELECT DISTINCT event_type AS source, json_extract_string(p, '$.k') AS target, 'calls' AS kind, '' AS label FROM (SELECT event_type, CAST(props AS JSON) AS p FROM events)
WHERE json_extract_string(p, '$.k') IS NOT NULL""",
)
def edges_from_json(s, d):
    e = C.table(s, d, "events").select(F.to_json(F.struct(F.col("event_type").alias("source"), F.get_json_object("props", "$.k").alias("target"), F.lit("calls").alias("kind"))).alias("line"))
    bad = s.createDataFrame([("not json",), ('{"source":"a"}',), ('{"source":"a","target":"a","kind":"calls"}',), ("[1]",)], "line string")
    return G.from_json(e.unionByName(bad))


CODE = """code AS (
  SELECT 'order:' || o_orderkey AS unit_id, 'src/' || o_orderpriority || '.py' AS path, 'o' || o_orderkey AS name, 'orders.o' || o_orderkey AS qualified_name, 'c' || o_custkey AS parent,
         ['c' || o_custkey, 'self.o' || o_orderkey, 'nowhere'] AS calls, ['pkg.' || o_orderstatus] AS imports FROM orders
  UNION ALL SELECT 'customer:' || c_custkey, 'lib/' || c_mktsegment || '.py', 'c' || c_custkey, 'customers.c' || c_custkey, '', ['c' || c_nationkey], ['x.n' || c_nationkey] FROM customer
  UNION ALL SELECT 'nation:' || n_nationkey, 'geo/n' || n_nationkey || '.py', 'n' || n_nationkey, 'nations.n' || n_nationkey, '', ['r' || n_regionkey], CAST([] AS VARCHAR[]) FROM nation)"""


def _code(s, d):
    def units(table, kind, key, path, name, qualified, parent, calls, imports):
        return C.table(s, d, table).select(_id(kind, key).alias("unit_id"), path.alias("path"), name.alias("name"), qualified.alias("qualified_name"), parent.alias("parent"), calls.alias("calls"), imports.alias("imports"))

    def t(prefix, col):
        return F.concat(F.lit(prefix), F.col(col).cast("string"))

    none = F.expr("cast(array() as array<string>)")
    o = units("orders", "order", "o_orderkey", F.concat(F.lit("src/"), "o_orderpriority", F.lit(".py")), t("o", "o_orderkey"), t("orders.o", "o_orderkey"), t("c", "o_custkey"), F.array(t("c", "o_custkey"), t("self.o", "o_orderkey"), F.lit("nowhere")), F.array(t("pkg.", "o_orderstatus")))
    c = units("customer", "customer", "c_custkey", F.concat(F.lit("lib/"), "c_mktsegment", F.lit(".py")), t("c", "c_custkey"), t("customers.c", "c_custkey"), F.lit(""), F.array(t("c", "c_nationkey")), F.array(t("x.n", "c_nationkey")))
    n = units("nation", "nation", "n_nationkey", F.concat(F.lit("geo/n"), F.col("n_nationkey").cast("string"), F.lit(".py")), t("n", "n_nationkey"), t("nations.n", "n_nationkey"), F.lit(""), F.array(t("r", "n_regionkey")), none)
    return o.unionByName(c).unionByName(n)


CONTAINS = "contains_ AS (SELECT 'customer:' || c_custkey AS source, 'order:' || o_orderkey AS target, 'contains' AS kind, 'c' || o_custkey AS label FROM orders JOIN customer ON c_custkey = o_custkey)"
CALLS = """calls_ AS (
  SELECT 'order:' || o_orderkey AS source, 'customer:' || c_custkey AS target, 'calls' AS kind, 'c' || o_custkey AS label FROM orders JOIN customer ON c_custkey = o_custkey
  UNION ALL SELECT 'customer:' || a.c_custkey, 'customer:' || b.c_custkey, 'calls', 'c' || a.c_nationkey FROM customer a JOIN customer b ON b.c_custkey = a.c_nationkey WHERE a.c_custkey <> b.c_custkey)"""
IMPORTS = "imports_ AS (SELECT 'customer:' || c_custkey AS source, 'nation:' || n_nationkey AS target, 'imports' AS kind, 'x.n' || c_nationkey AS label FROM customer JOIN nation ON n_nationkey = c_nationkey)"
_COLS = "source, target, kind, label"


@query("contains_edges", f"WITH {CONTAINS} SELECT {_COLS} FROM contains_")
def contains_edges(s, d):
    return G.contains_edges(_code(s, d))


@query("call_edges", f"WITH {CALLS} SELECT {_COLS} FROM calls_")
def call_edges(s, d):
    return G.call_edges(_code(s, d)).select("source", "target", "kind", "label")


@query("import_edges", f"WITH {IMPORTS} SELECT {_COLS} FROM imports_")
def import_edges(s, d):
    return G.import_edges(_code(s, d)).select("source", "target", "kind", "label")


@query("build_graph", f"WITH {CONTAINS}, {CALLS}, {IMPORTS} SELECT * FROM contains_ UNION SELECT * FROM calls_ UNION SELECT * FROM imports_")
def build_graph(s, d):
    return G.build(_code(s, d))


@query(
    "edge_budget",
    """WITH e AS (SELECT DISTINCT 'supplier:' || l_suppkey AS source, 'part:' || l_partkey AS target, 'imports' AS kind, '' AS label FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY target) AS rn FROM e) SELECT source, target, kind, label FROM r WHERE rn <= 64""",
)
def edge_budget(s, d):
    e = C.table(s, d, "lineitem").select(_id("supplier", "l_suppkey").alias("source"), _id("part", "l_partkey").alias("target"), F.lit("imports").alias("kind"), F.lit("").alias("label")).distinct()
    return G.budgeted(e.withColumn("pos", F.lit(0)).withColumn("charged_to", F.col("source")))


_WALK = """st AS (SELECT source, target, kind, kind || ':' || source || '->' || target AS step FROM (SELECT DISTINCT source, target, kind FROM valid)),
walk AS (SELECT source AS frm, 0 AS dir, kind AS k1, target AS k2, step, target AS dest FROM st UNION ALL SELECT target, 1, source, kind, step, source FROM st),
h0 AS (SELECT unit_id AS start_id, unit_id, 0 AS rank, unit_id AS path FROM ids WHERE unit_id LIKE 'region:%'),
c1 AS (SELECT h.start_id, w.dest AS unit_id, h.rank AS parent, dir, k1, k2, h.path || ' ' || step || ' ' || dest AS path FROM h0 h JOIN walk w ON w.frm = h.unit_id ANTI JOIN h0 v ON v.start_id = h.start_id AND v.unit_id = w.dest),
f1 AS (SELECT start_id, unit_id, arg_min((parent, dir, k1, k2, path), (parent, dir, k1, k2, path)) AS m FROM c1 GROUP BY start_id, unit_id),
h1 AS (SELECT start_id, unit_id, row_number() OVER (PARTITION BY start_id ORDER BY m[1], m[2], m[3], m[4], unit_id) AS rank, m[5] AS path FROM f1),
v1 AS (SELECT start_id, unit_id FROM h0 UNION ALL SELECT start_id, unit_id FROM h1),
c2 AS (SELECT h.start_id, w.dest AS unit_id, h.rank AS parent, dir, k1, k2, h.path || ' ' || step || ' ' || dest AS path FROM h1 h JOIN walk w ON w.frm = h.unit_id ANTI JOIN v1 v ON v.start_id = h.start_id AND v.unit_id = w.dest),
f2 AS (SELECT start_id, unit_id, arg_min((parent, dir, k1, k2, path), (parent, dir, k1, k2, path)) AS m FROM c2 GROUP BY start_id, unit_id),
h2 AS (SELECT start_id, unit_id, row_number() OVER (PARTITION BY start_id ORDER BY m[1], m[2], m[3], m[4], unit_id) AS rank, m[5] AS path FROM f2),
nb AS (SELECT start_id, 1 AS hop, rank, unit_id, path FROM h1 UNION ALL SELECT start_id, 2, rank, unit_id, path FROM h2)"""


def _regions(s, d):
    return C.table(s, d, "region").select(_id("region", "r_regionkey").alias("start_id"))


# all of these walk along "contains" edges, whose weight is 0.5
@query("neighbors", f"WITH {EDGES}, {_WALK} SELECT start_id, CAST(hop AS BIGINT) AS hop, CAST(rank AS BIGINT) AS rank, unit_id, path, CASE hop WHEN 1 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS weight FROM nb")
def neighbors(s, d):
    return G.neighbors(_edges(s, d), _regions(s, d), hops=2, units=_ids(s, d))


# seeds of a search over all edges: queries 0.. have the nations, scored by the number of
# their customers, 100.. the two orders of most lines and 200.. the two customers of most
# orders in a nation, so all kinds of edges are met
_SEEDS = """lines AS (SELECT c_nationkey AS n, l_orderkey AS k, count(*) AS c FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
placed AS (SELECT c_nationkey AS n, c_custkey AS k, count(*) AS c FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
tops AS (SELECT 100 + n AS query_id, 'order:' || k AS unit_id, c FROM lines UNION ALL SELECT 200 + n, 'customer:' || k, c FROM placed),
seeds AS (SELECT n_regionkey AS query_id, 'nation:' || n_nationkey AS unit_id, round(count(c_custkey) / 1000.0, 6) AS score FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2
  UNION ALL SELECT query_id, unit_id, round(c / 1000.0, 6) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, unit_id) AS rn FROM tops) WHERE rn <= 2),
rs AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM seeds)"""

_GS = f"""WITH {EDGES}, {_SEEDS},
st AS (SELECT DISTINCT source, target, kind FROM valid),
w1 AS (SELECT source AS frm, target AS dest, kind FROM st UNION ALL SELECT target, source, kind FROM st),
via AS (SELECT query_id, dest AS unit_id, score * CASE kind WHEN 'calls' THEN 0.7::DOUBLE WHEN 'contains' THEN 0.5::DOUBLE WHEN 'imports' THEN 0.3::DOUBLE ELSE 0.4::DOUBLE END AS score FROM seeds JOIN w1 ON frm = unit_id),
al AS (SELECT query_id, unit_id, score FROM seeds UNION ALL SELECT * FROM via),
b AS (SELECT query_id, unit_id, max(score) AS score FROM al GROUP BY 1, 2),
bb AS (SELECT b.query_id, b.unit_id, round(b.score, 6) AS score, NOT EXISTS (SELECT 1 FROM seeds s WHERE s.query_id = b.query_id AND s.unit_id = b.unit_id AND s.score = b.score) AS via_graph FROM b),
gr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM bb)"""


def _seeds(s, d):
    c, o = C.table(s, d, "customer").select("c_custkey", "c_nationkey"), C.table(s, d, "orders").select("o_orderkey", "o_custkey")
    nations = C.table(s, d, "nation").join(c, F.col("c_nationkey") == F.col("n_nationkey"))
    nations = nations.groupBy(F.col("n_regionkey").alias("query_id"), _id("nation", "n_nationkey").alias("unit_id")).agg(F.round(F.count("*") / 1000.0, 6).alias("score"))
    placed = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    lines = C.table(s, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("c")).join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
    tops = lines.select((F.col("c_nationkey") + 100).alias("query_id"), _id("order", "l_orderkey").alias("unit_id"), "c").unionByName(
        placed.groupBy((F.col("c_nationkey") + 200).alias("query_id"), _id("customer", "c_custkey").alias("unit_id")).agg(F.count("*").alias("c"))
    )
    two = R.ranked(tops.select("query_id", "unit_id", F.round(F.col("c") / 1000.0, 6).alias("score")), 2)
    return nations.unionByName(two.select("query_id", "unit_id", "score"))


@query("graph_search", f"{_GS} SELECT query_id, CAST(rank AS BIGINT) AS rank, unit_id, score, via_graph FROM gr WHERE rank <= 16")
def graph_search(s, d):
    return G.graph_search(durable(_seeds(s, d)), _edges(s, d), 16, units=_ids(s, d))


@query(
    "research",
    f"""{_GS},
dom AS (SELECT query_id, (max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2)) / max(score) FILTER (rank = 1) AS dm, count(*) AS k FROM rs GROUP BY query_id),
sure AS (SELECT query_id, coalesce(dm, 1.0) >= 0.30 AS sure FROM dom),
firm AS (SELECT rs.query_id, rs.rank, unit_id, score, 'high_confidence' AS stop_reason FROM rs JOIN sure USING (query_id) WHERE sure AND rs.rank <= 8),
more AS (SELECT query_id, unit_id, score FROM gr JOIN sure USING (query_id) WHERE NOT sure AND rank <= 16),
one AS (SELECT query_id, unit_id, max(score) AS score FROM (SELECT query_id, unit_id, score FROM rs JOIN sure USING (query_id) WHERE NOT sure UNION ALL SELECT * FROM more) GROUP BY 1, 2),
fresh AS (SELECT DISTINCT query_id FROM more m ANTI JOIN rs ON rs.query_id = m.query_id AND rs.unit_id = m.unit_id),
rest AS (SELECT o.query_id, row_number() OVER (PARTITION BY o.query_id ORDER BY score DESC, unit_id) AS rank, unit_id, score,
         CASE WHEN f.query_id IS NOT NULL THEN 'new_graph_evidence' ELSE 'no_new_evidence' END AS stop_reason FROM one o LEFT JOIN fresh f ON f.query_id = o.query_id)
SELECT query_id, CAST(rank AS BIGINT) AS rank, unit_id, score, stop_reason FROM (SELECT * FROM firm UNION ALL SELECT * FROM rest WHERE rank <= 8)""",
)
def research(s, d):
    return G.research(durable(R.ranked(_seeds(s, d), 1 << 30)), _edges(s, d), 8, units=_ids(s, d))


# lines: pages cut behind each tag

RULES = [("section", r"<(article|nav|footer|div)[ >]?"), ("block", r"<(h1|ul|p)$")]
_LINES = """ln AS (SELECT page_id, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line FROM (SELECT page_id, string_split(html, '>') AS ls FROM pages)),
decl AS (SELECT page_id, line_no, CASE WHEN regexp_matches(line, '<(article|nav|footer|div)[ >]?') THEN 'section' ELSE 'block' END AS kind,
         CASE WHEN regexp_matches(line, '<(article|nav|footer|div)[ >]?') THEN regexp_extract(line, '<(article|nav|footer|div)[ >]?', 1) ELSE regexp_extract(line, '<(h1|ul|p)$', 1) END AS name
  FROM ln WHERE trim(line) <> '' AND NOT regexp_matches(line, '^\\s*<!--') AND (regexp_matches(line, '<(article|nav|footer|div)[ >]?') OR regexp_matches(line, '<(h1|ul|p)$'))),
dp AS (SELECT page_id, line_no, line, len(regexp_extract_all(line, '<[a-z]')) - len(regexp_extract_all(line, '</')) AS change FROM ln),
dd AS (SELECT *, sum(change) OVER (PARTITION BY page_id ORDER BY line_no) AS depth FROM dp)"""


def _page_lines(s, d):
    return L.numbered(C.table(s, d, "pages"), "page_id", F.col("html"), ">")


def _decls(s, d):
    return L.declarations(_page_lines(s, d), "page_id", RULES, r"^\s*<!--")


@query("line_scan", f"WITH {_LINES} SELECT page_id AS doc, CAST(line_no AS BIGINT) AS line_no, kind, name FROM decl")
def line_scan(s, d):
    return _decls(s, d).withColumnRenamed("page_id", "doc")


@query("brace_depth", f"WITH {_LINES} SELECT page_id AS doc, CAST(line_no AS BIGINT) AS line_no, CAST(depth AS BIGINT) AS depth FROM dd")
def brace_depth(s, d):
    return L.depths(_page_lines(s, d), "page_id", "<[a-z]", "</").select(F.col("page_id").alias("doc"), "line_no", "depth")


@query("next_decl_span", f"WITH {_LINES}, l AS (SELECT page_id, max(line_no) AS last FROM ln GROUP BY 1) SELECT page_id AS doc, CAST(line_no AS BIGINT) AS start_line, CAST(coalesce(lead(line_no) OVER (PARTITION BY page_id ORDER BY line_no) - 1, last) AS BIGINT) AS end_line FROM decl JOIN l USING (page_id)")
def next_decl_span(s, d):
    return L.next_declaration_spans(_decls(s, d), _page_lines(s, d), "page_id").withColumnRenamed("page_id", "doc")


_SPANS = """sp AS (SELECT o.page_id, o.line_no AS start_line, min(c.line_no) AS end_line FROM (SELECT dd.*, depth - change AS outer_ FROM dd SEMI JOIN decl USING (page_id, line_no)) o
  JOIN dd c ON c.page_id = o.page_id AND c.line_no >= o.line_no AND c.depth <= o.outer_ GROUP BY 1, 2)"""


def _spans(s, d):
    return L.closing_spans(_decls(s, d), L.depths(_page_lines(s, d), "page_id", "<[a-z]", "</"), "page_id")


@query("brace_span_close", f"WITH {_LINES}, {_SPANS} SELECT page_id AS doc, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line FROM sp")
def brace_span_close(s, d):
    return _spans(s, d).withColumnRenamed("page_id", "doc")


@query(
    "span_containment",
    f"""WITH {_LINES}, {_SPANS}, u AS (SELECT sp.*, name FROM sp JOIN decl ON decl.page_id = sp.page_id AND decl.line_no = sp.start_line),
up AS (SELECT u.page_id, u.start_line, string_agg(o.name, '.' ORDER BY o.start_line, o.name) AS path FROM u JOIN u o ON o.page_id = u.page_id AND o.start_line <= u.start_line AND u.end_line <= o.end_line AND NOT (o.start_line = u.start_line AND o.end_line = u.end_line) GROUP BY 1, 2)
SELECT u.page_id AS doc, CAST(u.start_line AS BIGINT) AS start_line, CASE WHEN path IS NULL THEN name ELSE path || '.' || name END AS qualified_name FROM u LEFT JOIN up USING (page_id, start_line)""",
)
def span_containment(s, d):
    n = _decls(s, d).select("page_id", F.col("line_no").alias("start_line"), "name")
    return L.contained(_spans(s, d).join(n, ["page_id", "start_line"]), "page_id").withColumnRenamed("page_id", "doc")


@query(
    "comment_blocks",
    r"""WITH ln AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
m AS (SELECT *, regexp_matches(line, '^[A-M]') AS c, regexp_matches(line, '^[N-Z]') AS d FROM ln),
i AS (SELECT *, line_no - sum(CASE WHEN c THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM m),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY line_no DESC) AS back, max(line_no) OVER (PARTITION BY doc_id, island) AS last FROM i WHERE c),
r AS (SELECT doc_id, last + 1 AS decl_line, left(string_agg(trim(line), ' ' ORDER BY line_no), 600) AS comment FROM k WHERE back <= 20 GROUP BY doc_id, island, last)
SELECT m.doc_id AS doc, CAST(m.line_no AS BIGINT) AS decl_line, comment FROM m JOIN r ON r.doc_id = m.doc_id AND r.decl_line = m.line_no WHERE d""",
)
def comment_blocks(s, d):
    n = L.numbered(C.table(s, d, "documents"), "doc_id", F.col("text"))
    return L.comment_runs(n, "doc_id", F.col("line").rlike("^[A-M]"), F.col("line").rlike("^[N-Z]")).withColumnRenamed("doc_id", "doc")


@query(
    "open_range",
    """SELECT doc_id, CAST(2 AS BIGINT) AS start_line, CAST(least(len(ls), 202) AS BIGINT) AS end_line, CAST(least(length(t), 2000) AS BIGINT) AS n_chars, length(t) > 2000 AS truncated
FROM (SELECT doc_id, ls, array_to_string(ls[2:202], chr(10)) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) WHERE len(ls) >= 2)""",
)
def open_range(s, d):
    t = C.table(s, d, "documents").select("doc_id", T.lines(F.col("text")).alias("ls")).where(F.size("ls") >= 2)
    part = F.length(F.array_join(F.slice("ls", 2, 201), "\n"))
    return t.select("doc_id", F.lit(2).cast("long").alias("start_line"), F.least(F.size("ls"), F.lit(202)).cast("long").alias("end_line"), F.least(part, F.lit(2000)).cast("long").alias("n_chars"), (part > 2000).alias("truncated"))


_SER = f"WITH {UNITS}, s AS (SELECT *, row_number() OVER (ORDER BY path, doc_id, qualified_name, unit_id) AS serial FROM units)"


def _ordered_units(s, d):
    return C.units(C.table(s, d, "documents")).withColumn("start_line", F.col("doc_id"))


@query("annotate_lines", f"{_SER} SELECT CAST(serial AS BIGINT) AS serial, 'RAG[' || printf('%05d', serial) || '] ' || unit_id || ': ' || description AS line FROM s")
def annotate_lines(s, d):
    u = _ordered_units(s, d)
    j = u.join(S.global_serials(u), "unit_id")
    return j.select("serial", F.format_string("RAG[%05d] %s: %s", "serial", "unit_id", "description").alias("line"))


# incremental: what labels covers is the previous snapshot; texts of low quality changed

FILES = """files AS (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, text FROM documents),
old AS (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, CASE WHEN quality = 0 THEN upper(text) ELSE text END AS text FROM documents JOIN labels USING (doc_id))"""


def _path():
    return F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


def _files(s, d):
    return C.table(s, d, "documents").select(_path().alias("path"), "text")


def _old(s, d):
    j = C.table(s, d, "documents").join(C.table(s, d, "labels"), "doc_id")
    return j.select(_path().alias("path"), F.when(F.col("quality") == 0, F.upper("text")).otherwise(F.col("text")).alias("text"))


def _hashed(df):
    return df.select("path", S.digest(F.col("text")).alias("sha256"), F.octet_length("text").cast("long").alias("size"))


@query("scan_filter", f"WITH {FILES} SELECT path FROM files WHERE NOT (split_part(path, '/', 1) IN ('src3', 'src7') OR split_part(path, '/', 1) LIKE '.%') AND octet_length(encode(text)) <= 5000 AND lower(path) LIKE '%.txt'")
def scan_filter(s, d):
    f = _files(s, d)
    top = F.split_part("path", F.lit("/"), F.lit(1))
    return f.where(~(top.isin("src3", "src7") | top.startswith(".")) & (F.octet_length("text") <= 5000) & F.lower("path").endswith(".txt")).select("path")


@query("snapshot_hash", f"WITH {FILES} SELECT path, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM files")
def snapshot_hash(s, d):
    return _hashed(_files(s, d))


@query("file_stats", f"WITH {FILES} SELECT path, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM files")
def file_stats(s, d):
    return _files(s, d).select("path", F.octet_length("text").cast("long").alias("size"))


@query("repo_fingerprint", f"WITH {FILES} SELECT count(*) AS n, sha256(coalesce(string_agg(path || sha256(text), '' ORDER BY path), '')) AS fingerprint FROM files")
def repo_fingerprint(s, d):
    return S.ordered_digest(_hashed(_files(s, d)), "path", F.concat("path", "sha256"))


@query("corpus_stamp", f"WITH {UNITS} SELECT count(*) AS n, left(sha256(coalesce(string_agg(unit_id || concat_ws(chr(10), qualified_name || ' ' || kind, signature, description, 'calls: ' || chr(10) || 'imports: ', source), '' ORDER BY unit_id), '')), 12) AS fingerprint FROM units")
def corpus_stamp(s, d):
    u = C.fields(C.units(C.table(s, d, "documents")))
    return S.ordered_digest(u, "unit_id", F.concat("unit_id", C.searchable_text())).withColumn("fingerprint", F.left("fingerprint", F.lit(12)))


@query("stale_diff", f"WITH {FILES} SELECT path, CASE WHEN o.text IS NULL THEN 'added' WHEN f.text IS NULL THEN 'removed' ELSE 'changed' END AS change FROM files f FULL JOIN old o USING (path) WHERE o.text IS NULL OR f.text IS NULL OR sha256(o.text) <> sha256(f.text)")
def stale_diff(s, d):
    old, new = (_hashed(x).select("path", F.col("sha256").alias("stat")) for x in (_old(s, d), _files(s, d)))
    return S.stale_diff(old, new)


@query("incremental_split", f"WITH {FILES} SELECT path, CASE WHEN sha256(o.text) = sha256(f.text) THEN 'reuse' ELSE 'parse' END AS action FROM files f LEFT JOIN old o USING (path)")
def incremental_split(s, d):
    return S.incremental_split(_hashed(_old(s, d)), _hashed(_files(s, d)))


@query("global_serials", f"{_SER} SELECT unit_id, CAST(serial AS BIGINT) AS serial FROM s")
def global_serials(s, d):
    return S.global_serials(_ordered_units(s, d))


_STABLE = f"""WITH {UNITS}, prev AS (SELECT source || ':' || doc_id AS unit_id, n_chars AS serial FROM documents SEMI JOIN labels USING (doc_id)),
j AS (SELECT u.*, p.serial AS old FROM units u LEFT JOIN prev p USING (unit_id)),
k AS (SELECT *, CASE WHEN old > 0 THEN row_number() OVER (PARTITION BY old ORDER BY path, doc_id, qualified_name, unit_id) END AS rn FROM j),
fin AS (SELECT unit_id, old AS serial FROM k WHERE rn = 1
UNION ALL SELECT unit_id, row_number() OVER (ORDER BY path, doc_id, qualified_name, unit_id) + (SELECT greatest(max(serial), 0) FROM prev) FROM k WHERE rn IS NULL OR rn > 1)"""


def _prev_serials(s, d):
    j = C.table(s, d, "documents").join(C.table(s, d, "labels"), "doc_id", "left_semi")
    return j.select(F.concat("source", F.lit(":"), F.col("doc_id").cast("string")).alias("unit_id"), F.col("n_chars").alias("serial"))


@query("stable_serials", f"{_STABLE} SELECT unit_id, CAST(serial AS BIGINT) AS serial FROM fin")
def stable_serials(s, d):
    return S.stable_serials(_ordered_units(s, d), _prev_serials(s, d))


@query(
    "vector_reuse",
    f"""{_STABLE}, {FILES} SELECT fin.unit_id, coalesce(sha256(o.text) = sha256(d.text) AND d.n_chars = fin.serial AND lb.doc_id IS NOT NULL, false) AS reused FROM fin
JOIN documents d ON d.source || ':' || d.doc_id = fin.unit_id LEFT JOIN labels lb ON lb.doc_id = d.doc_id LEFT JOIN old o ON o.path = d.source || '/' || d.lang || '/' || d.doc_id || '.txt'""",
)
def vector_reuse(s, d):
    u = _ordered_units(s, d)
    now = S.stable_serials(u, _prev_serials(s, d)).join(u.select("unit_id", S.digest(F.col("source")).alias("text_sha"), F.lit(384).alias("width")), "unit_id")
    j = C.table(s, d, "documents").join(C.table(s, d, "labels"), "doc_id")
    text = F.when(F.col("quality") == 0, F.upper("text")).otherwise(F.col("text"))
    was = j.select(F.concat("source", F.lit(":"), F.col("doc_id").cast("string")).alias("unit_id"), S.digest(text).alias("text_sha"), F.lit(384).alias("width"), F.col("n_chars").alias("serial"))
    return S.vector_reuse(now, was)


@query("index_degraded", "SELECT * FROM (VALUES ('whole', false), ('no_vectors', true), ('other_width', true)) v(published, degraded)")
def index_degraded(s, d):
    """Three indexes of the benchmark passages are published and loaded: one whole, one
    without vectors, one whose vectors have another width than it says."""
    import uuid

    from siftwell.operators.durable import shared_dir
    from siftwell.sources import index_store

    b = C.table(s, d, "benchmark")
    units = C.units(b.select(F.col("item_id").alias("doc_id"), "text", F.lit("en").alias("lang"), F.lit("bench").alias("source"))).drop("doc_id")
    edges = s.createDataFrame([], "source string, target string, kind string, label string")
    v = units.select("unit_id", F.array_repeat(F.lit(1.0), 32).alias("vector"))
    root = f"{shared_dir(s).removeprefix('file://')}/degraded-{uuid.uuid4().hex}"
    rows = []
    for name, vectors, width in (("whole", v, 32), ("no_vectors", None, 32), ("other_width", v, 64)):
        index_store.publish(f"{root}/{name}", units, edges, vectors, {"dimensions": width})
        got = index_store.load(s, f"{root}/{name}")
        rows.append((name, got["degraded"] is not None))
    return s.createDataFrame(rows, "published string, degraded boolean")


@query("synth_repo", "SELECT 'module_' || printf('%05d', f) || '.py' AS path, CAST(count(*) AS BIGINT) AS n_functions FROM range(500) a(f), range(20) b(g) GROUP BY 1")
def synth_repo(s, d):
    from siftwell.sources.synthetic import functions

    return functions(s, 500, 20).groupBy("path").agg(F.count("*").alias("n_functions"))


# store: labels make the entries; toxic ones were stored under another id, those of low
# quality for another source

STORE = f"""WITH {UNITS}, un AS (SELECT unit_id, path, qualified_name, left(sha256(source), 16) AS hash, left(sha256('c' || source), 16) AS code_hash FROM units),
en AS (SELECT CASE WHEN toxic = 1 THEN 'old:' || unit_id ELSE unit_id END AS unit_id, path, qualified_name AS name, CASE WHEN quality = 1 THEN left(sha256(u.source), 16) ELSE left(sha256('x' || u.source), 16) END AS hash,
         CASE WHEN quality = 1 OR toxic = 0 THEN left(sha256('c' || u.source), 16) END AS code_hash, 'about ' || name AS text FROM units u JOIN labels USING (doc_id)),
r1 AS (SELECT path, hash AS digest, count(DISTINCT text) AS n, min(text) AS text FROM en WHERE hash IS NOT NULL GROUP BY 1, 2),
r2 AS (SELECT path, code_hash AS digest, count(DISTINCT text) AS n, min(text) AS text FROM en WHERE code_hash IS NOT NULL GROUP BY 1, 2),
ap0 AS (SELECT un.*, a.text AS t1, CASE WHEN b.n = 1 THEN b.text END AS t2, c.text AS t3, CASE WHEN e.n = 1 THEN e.text END AS t4 FROM un
  LEFT JOIN en a ON a.unit_id = un.unit_id AND a.hash = un.hash LEFT JOIN r1 b ON b.path = un.path AND b.digest = un.hash
  LEFT JOIN en c ON c.unit_id = un.unit_id AND c.code_hash = un.code_hash LEFT JOIN r2 e ON e.path = un.path AND e.digest = un.code_hash),
ap AS (SELECT *, CASE WHEN t1 IS NOT NULL THEN 1 WHEN t2 IS NOT NULL THEN 2 WHEN t3 IS NOT NULL THEN 3 WHEN t4 IS NOT NULL THEN 4 END AS tier, coalesce(t1, t2, t3, t4) AS txt FROM ap0),
stt AS (SELECT ap.unit_id, ap.path, ap.qualified_name, CASE WHEN tier IS NOT NULL THEN 'described' WHEN EXISTS (SELECT 1 FROM en WHERE en.unit_id = ap.unit_id OR (en.path = ap.path AND en.name = ap.qualified_name)) THEN 'superseded' ELSE 'missing' END AS state FROM ap)"""


def _store_units(s, d):
    u = C.units(C.table(s, d, "documents"))
    return u.select("unit_id", "path", "qualified_name", T.source_key(F.col("source")).alias("hash"), T.source_key(F.concat(F.lit("c"), "source")).alias("code_hash"))


def _entries(s, d):
    u = C.units(C.table(s, d, "documents")).join(C.table(s, d, "labels"), "doc_id")
    src = F.col("source")
    return u.select(
        F.when(F.col("toxic") == 1, F.concat(F.lit("old:"), "unit_id")).otherwise(F.col("unit_id")).alias("unit_id"), "path", F.col("qualified_name").alias("name"),
        F.when(F.col("quality") == 1, T.source_key(src)).otherwise(T.source_key(F.concat(F.lit("x"), src))).alias("hash"),
        F.when((F.col("quality") == 1) | (F.col("toxic") == 0), T.source_key(F.concat(F.lit("c"), src))).alias("code_hash"), F.concat(F.lit("about "), "name").alias("text"),
    )


@query("applicable_descriptions", f"{STORE} SELECT unit_id, CAST(tier AS BIGINT) AS tier, sha256(txt) AS text_sha FROM ap WHERE tier IS NOT NULL")
def applicable_descriptions(s, d):
    return D.applicable(_store_units(s, d), _entries(s, d)).select("unit_id", "tier", S.digest(F.col("text")).alias("text_sha"))


@query("relocations", f"{STORE} SELECT path, digest, n > 1 AS ambiguous FROM r1")
def relocations(s, d):
    return D.relocations(_entries(s, d)).drop("text")


@query("describe_status", f"{STORE} SELECT state, CAST(count(*) AS BIGINT) AS n FROM stt GROUP BY state")
def describe_status(s, d):
    return D.states(_store_units(s, d), _entries(s, d)).groupBy("state").agg(F.count("*").alias("n"))


SKIP = ["src1/*", "*::src2.doc_*", "fr.txt"]
_SKIP = "(regexp_matches(path, '(?:^|/)src1/[^/]*$') OR regexp_matches(path, '(?:^|/)fr\\.txt$') OR regexp_matches(path || '::' || qualified_name, '(?:^|/)src1/[^/]*$') OR regexp_matches(path || '::' || qualified_name, '(?:^|/)[^/]*::src2\\.doc_[^/]*$') OR regexp_matches(path, '(?:^|/)[^/]*::src2\\.doc_[^/]*$') OR regexp_matches(path || '::' || qualified_name, '(?:^|/)fr\\.txt$'))"


@query("pending_queue", f"{STORE}, p AS (SELECT *, row_number() OVER (ORDER BY CASE state WHEN 'missing' THEN 0 ELSE 1 END, unit_id) AS pos FROM stt WHERE state <> 'described' AND NOT {_SKIP}) SELECT CAST(pos AS BIGINT) AS pos, unit_id, state FROM p WHERE pos <= 20")
def pending_queue(s, d):
    return D.pending(_store_units(s, d), _entries(s, d), SKIP, 20)


@query("glob_filter", f"WITH {UNITS} SELECT DISTINCT path || '::' || qualified_name AS path, {_SKIP} AS withheld FROM units")
def glob_filter(s, d):
    u = _store_units(s, d)
    return u.select(F.concat("path", F.lit("::"), "qualified_name").alias("path"), D.withheld(F.col("path"), F.col("qualified_name"), SKIP).alias("withheld")).distinct()


@query("prune_store", f"{STORE} SELECT unit_id, EXISTS (SELECT 1 FROM un WHERE un.unit_id = en.unit_id OR (un.path = en.path AND (un.hash = en.hash OR un.code_hash = en.code_hash))) AS kept FROM en")
def prune_store(s, d):
    return D.pruned(_entries(s, d), _store_units(s, d))


@query("upsert_descriptions", f"{STORE}, nw AS (SELECT unit_id, 'new ' || unit_id AS text FROM un SEMI JOIN (SELECT source || ':' || doc_id AS u FROM documents WHERE lang = 'es') e ON e.u = un.unit_id) SELECT unit_id, sha256(text) AS text_sha FROM (SELECT unit_id, text FROM en ANTI JOIN nw USING (unit_id) UNION ALL SELECT * FROM nw)")
def upsert_descriptions(s, d):
    u = C.units(C.table(s, d, "documents")).where("language = 'es'").select("unit_id", F.concat(F.lit("new "), "unit_id").alias("text"))
    return D.upserted(_entries(s, d).select("unit_id", "text"), u).select("unit_id", S.digest(F.col("text")).alias("text_sha"))


_ITEMS = "it AS (SELECT conv_id || ':' || turn AS id, CASE WHEN role = 'system' THEN NULL ELSE 'src' || (turn + 1) || ':' || conv_id END AS unit_id, text FROM conversations)"


@query("validate_items", f"WITH {UNITS}, {_ITEMS} SELECT id, CASE WHEN it.unit_id IS NULL THEN 'not_an_object' WHEN NOT EXISTS (SELECT 1 FROM units u WHERE u.unit_id = it.unit_id) THEN 'unknown_unit' WHEN length(trim(coalesce(text, ''))) = 0 THEN 'empty' WHEN length(trim(text)) > 200 THEN 'too_long:' || length(trim(text)) || '/200' ELSE 'ok' END AS reason FROM it")
def validate_items(s, d):
    c = C.table(s, d, "conversations")
    items = c.select(F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("id"), F.when(F.col("role") != "system", F.concat(F.lit("src"), (F.col("turn") + 1).cast("string"), F.lit(":"), F.col("conv_id").cast("string"))).alias("unit_id"), "text")
    return D.validated(items, C.units(C.table(s, d, "documents")), 200)


@query("desc_fingerprint", f"{STORE} SELECT CASE WHEN count(*) = 0 THEN '' ELSE sha256(string_agg(unit_id || coalesce(hash, '') || text, '' ORDER BY unit_id)) END AS fingerprint FROM en")
def desc_fingerprint(s, d):
    return D.fingerprint(_entries(s, d))


@query("bootstrap_rung", f"{STORE} SELECT CASE WHEN r > 0 THEN 'describe' WHEN p > 0 THEN 'promote' ELSE 'ready' END AS action, CAST(r AS BIGINT) AS remaining, CAST(ceil(r / 20.0) AS BIGINT) AS rounds FROM (SELECT count(*) FILTER (state <> 'described') AS r, count(*) FILTER (state = 'described') AS p FROM stt)")
def bootstrap_rung(s, d):
    st = D.states(_store_units(s, d), _entries(s, d))
    counts = st.agg(F.count_if(F.col("state") != "described").alias("remaining"), F.count_if(F.col("state") == "described").alias("promotable"))
    return D.bootstrap_rung(counts, 20)


@query("insertion_plan", f"{STORE} SELECT ap.path, u.doc_id AS line, ap.unit_id FROM ap JOIN units u USING (unit_id) WHERE tier IS NOT NULL AND u.language <> 'de' AND NOT contains(u.source, txt)")
def insertion_plan(s, d):
    u = C.units(C.table(s, d, "documents"))
    a = D.applicable(_store_units(s, d), _entries(s, d))
    j = u.join(a, "unit_id").where((F.col("language") != "de") & ~F.contains("source", "text"))
    return j.select("path", F.col("doc_id").alias("line"), "unit_id")


_DOC = f"""{STORE}, pl AS (SELECT ap.path, ap.unit_id, u.language, contains(u.source, txt) AS shown FROM ap JOIN units u USING (unit_id) WHERE tier IS NOT NULL)
SELECT 'already_documented' AS metric, CAST(count(*) FILTER (shown) AS BIGINT) AS value FROM pl UNION ALL SELECT 'no_convention', CAST(count(*) FILTER (language = 'de') AS BIGINT) FROM pl UNION ALL SELECT 'files_touched', CAST(count(DISTINCT path) AS BIGINT) FROM pl"""


@query("doc_summary", _DOC)
def doc_summary(s, d):
    j = C.units(C.table(s, d, "documents")).join(D.applicable(_store_units(s, d), _entries(s, d)), "unit_id")
    one = j.agg(F.count_if(F.contains("source", "text")).alias("already_documented"), F.count_if(F.col("language") == "de").alias("no_convention"), F.count_distinct("path").alias("files_touched"))
    return one.unpivot([], ["already_documented", "no_convention", "files_touched"], "metric", "value")


@query("index_stats", f"WITH {UNITS}, {EDGES} SELECT 'units' AS metric, CAST(count(*) AS BIGINT) AS value FROM units UNION ALL SELECT 'files', CAST(count(DISTINCT path) AS BIGINT) FROM units UNION ALL SELECT 'edges', CAST(count(*) AS BIGINT) FROM valid")
def index_stats(s, d):
    u = C.units(C.table(s, d, "documents")).agg(F.count("*").alias("units"), F.count_distinct("path").alias("files")).unpivot([], ["units", "files"], "metric", "value")
    return u.unionByName(G.valid(_edges(s, d), _ids(s, d)).agg(F.lit("edges").alias("metric"), F.count("*").alias("value")))


# evaluation: an answer is acceptable if it holds the question's passage

EVAL = f"""WITH {RANK},
lx AS (SELECT query_id, unit_id, rank FROM (SELECT query_id, unit_id, row_number() OVER (PARTITION BY query_id ORDER BY round(lexical, 6) DESC, unit_id) AS rank FROM lex) WHERE rank <= 8),
acc AS (SELECT q.query_id, u.unit_id FROM q JOIN units u ON contains(u.source, q.query)),
rm AS (SELECT q.query_id, coalesce(CAST(min(rank) = 1 AS BIGINT), 0) AS hit_at_1, CAST(min(rank) IS NOT NULL AS BIGINT) AS hit_at_k, coalesce(1.0 / min(rank), 0.0) AS rr
  FROM q LEFT JOIN (SELECT lx.* FROM lx JOIN acc USING (query_id, unit_id)) h USING (query_id) GROUP BY q.query_id),
qd AS (SELECT query_id, CASE WHEN regexp_matches(query, '[^\\x00-\\x7F]') THEN 'accented' ELSE 'plain' END AS language, CASE WHEN length(query) > 250 THEN 'long' ELSE 'short' END AS kind FROM q)"""


def _accept(s, d, at=None):
    u = C.units(C.table(s, d, "documents")).select("unit_id", "source")
    return durable(E.holding(V._questions(s, d), at or V._probe(s, d), u))


def _lexical_top(s, d, at=None):
    at = at or V._probe(s, d)
    return R.ranked(at.best(V._n(s, d), R.LIMIT).withColumnRenamed("lexical", "score"))


def _metrics(s, d, at, acc):
    return E.rank_metrics(V._questions(s, d), _lexical_top(s, d, at), acc)


def _judged(s, d):
    """One probe of the index and the acceptable answers, which an evaluation shares."""
    at = V._probe(s, d)
    return at, _accept(s, d, at)


def _declared(s, d, at):
    return R.evidence(V._questions(s, d), at, V._n(s, d)).select("query_id", "sufficient")


def _dims(s, d):
    q = V._questions(s, d)
    return q.select("query_id", F.when(F.col("query").rlike(r"[^\x00-\x7F]"), "accented").otherwise("plain").alias("language"), F.when(F.length("query") > 250, "long").otherwise("short").alias("kind"))


@query("rank_metrics", f"{EVAL} SELECT query_id, hit_at_1, hit_at_k, round(rr, 6) AS rr FROM rm")
def rank_metrics(s, d):
    return _metrics(s, d, *_judged(s, d)).withColumn("rr", F.round("rr", 6))


_SETS = """SELECT {cols} FROM (SELECT *, 'all' AS dim, 'all' AS value FROM {t} UNION ALL SELECT *, 'language', language FROM {t} UNION ALL SELECT *, 'kind', kind FROM {t}) GROUP BY dim, value"""


@query("ruler_report", f"{EVAL}, a AS (SELECT * FROM rm JOIN qd USING (query_id) JOIN (SELECT query_id, sufficient FROM ev) USING (query_id) WHERE query_id IN (SELECT query_id FROM acc)) " + _SETS.format(t="a", cols="dim, value, CAST(count(*) AS BIGINT) AS n, round(avg(hit_at_1), 6) AS hit_at_1, round(avg(hit_at_k), 6) AS hit_at_k, round(avg(rr), 6) AS mrr, CAST(count(*) FILTER (NOT sufficient) AS BIGINT) AS declined"))
def ruler_report(s, d):
    at, acc = _judged(s, d)
    a = _metrics(s, d, at, acc).join(_dims(s, d), "query_id").join(_declared(s, d, at), "query_id")
    a = a.join(acc.select("query_id").distinct(), "query_id", "left_semi")
    aggs = [F.count("*").alias("n"), F.round(F.avg("hit_at_1"), 6).alias("hit_at_1"), F.round(F.avg("hit_at_k"), 6).alias("hit_at_k"), F.round(F.avg("rr"), 6).alias("mrr"), F.count_if(~F.col("sufficient")).alias("declined")]
    return E.by_dimensions(a, ["language", "kind"], aggs)


@query("silence_report", f"{EVAL}, a AS (SELECT * FROM ev JOIN qd USING (query_id) WHERE query_id NOT IN (SELECT query_id FROM acc)) " + _SETS.format(t="a", cols="dim, value, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN sufficient THEN 0.0 ELSE 1.0 END), 6) AS silence"))
def silence_report(s, d):
    at, acc = _judged(s, d)
    a = _declared(s, d, at).join(_dims(s, d), "query_id").join(acc.select("query_id").distinct(), "query_id", "left_anti")
    return E.by_dimensions(a, ["language", "kind"], [F.count("*").alias("n"), F.round(F.avg(F.when(F.col("sufficient"), 0.0).otherwise(1.0)), 6).alias("silence")])


@query(
    "retrieval_metrics",
    f"""{EVAL}, g AS (SELECT lx.query_id, count(*) AS got, count(acc.unit_id) AS good FROM lx LEFT JOIN acc USING (query_id, unit_id) GROUP BY 1), w AS (SELECT query_id, count(*) AS want FROM acc GROUP BY 1)
SELECT 'precision_at_k' AS metric, round(avg(good / CAST(got AS DOUBLE)), 6) AS value FROM g JOIN w USING (query_id) UNION ALL SELECT 'recall_at_k', round(avg(good / CAST(want AS DOUBLE)), 6) FROM g JOIN w USING (query_id)
UNION ALL SELECT 'top1', round(avg(hit_at_1), 6) FROM rm JOIN w USING (query_id) UNION ALL SELECT 'mrr', round(avg(rr), 6) FROM rm JOIN w USING (query_id)""",
)
def retrieval_metrics(s, d):
    at, acc = _judged(s, d)
    g = _lexical_top(s, d, at).join(acc.withColumn("good", F.lit(1)), ["query_id", "unit_id"], "left").groupBy("query_id").agg(F.count("*").alias("got"), F.count("good").alias("good"))
    w = acc.groupBy("query_id").agg(F.count("*").alias("want"))
    j = w.join(g, "query_id", "left").join(_metrics(s, d, at, acc), "query_id", "left")
    one = j.agg(F.avg(F.col("good") / F.col("got")).alias("precision_at_k"), F.avg(F.col("good") / F.col("want")).alias("recall_at_k"), F.avg("hit_at_1").alias("top1"), F.avg("rr").alias("mrr"))
    names = ["precision_at_k", "recall_at_k", "top1", "mrr"]
    return one.unpivot([], names, "metric", "value").withColumn("value", F.round("value", 6))


@query("ruler_check", f"WITH {QUERY} SELECT query_id, 'no_acceptable_answer_in_index' AS problem FROM q WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, q.query))")
def ruler_check(s, d):
    q = V._questions(s, d).select("query_id")
    return q.join(_accept(s, d), "query_id", "left_anti").select("query_id", F.lit("no_acceptable_answer_in_index").alias("problem"))


@query("absent_intruders", f"{EVAL} SELECT query_id, term, CAST(df AS BIGINT) AS df FROM st WHERE df > 0 AND query_id NOT IN (SELECT query_id FROM acc)")
def absent_intruders(s, d):
    at, acc = _judged(s, d)
    st = R.term_states(at, V._n(s, d)).where("df > 0")
    return st.join(acc.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "term", "df")


_GREP = f"""WITH {QUERY}, ws AS (SELECT query_id, term AS word FROM qt WHERE length(term) >= 4),
ln AS (SELECT path, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line FROM (SELECT source || '/' || lang || '/' || doc_id AS path, string_split(text, chr(10)) AS ls FROM documents)),
dw AS (SELECT DISTINCT word FROM ws),
lh AS (SELECT path, line_no, line, word FROM ln JOIN dw ON contains(lower(line), word)),
h AS (SELECT query_id, path, line_no, line, word FROM lh JOIN ws USING (word)),
a AS (SELECT query_id, path, count(DISTINCT word) AS words FROM h GROUP BY 1, 2),
b AS (SELECT query_id, path, count(*) AS lines, sum(length(line)) AS chars FROM (SELECT DISTINCT query_id, path, line_no, line FROM h) GROUP BY 1, 2)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY words DESC, path) AS BIGINT) AS rank, path, CAST(words AS BIGINT) AS words, CAST(lines AS BIGINT) AS lines, CAST(chars AS BIGINT) AS chars FROM a JOIN b USING (query_id, path)"""


@query("grep_baseline", _GREP)
def grep_baseline(s, d):
    docs = C.table(s, d, "documents").select(F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), "text")
    words = R.query_terms(V._questions(s, d)).where(F.length("term") >= 4).select("query_id", F.col("term").alias("word"))
    return E.grep_loop(docs, words)


_TESTPATH = "CASE WHEN language = 'fr' THEN 'tests/' || path ELSE path END"


@query("displacement", f"{EVAL} SELECT query_id, coalesce(bool_or(rank = 1 AND u.language = 'fr'), false) AND coalesce(bool_or(rank > 1 AND acc.unit_id IS NOT NULL), false) AS displaced FROM lx JOIN units u USING (unit_id) LEFT JOIN acc USING (query_id, unit_id) GROUP BY query_id")
def displacement(s, d):
    u = C.units(C.table(s, d, "documents"))
    tests = u.where(E.is_test(F.when(F.col("language") == "fr", F.concat(F.lit("tests/"), "path")).otherwise(F.col("path")))).select("unit_id")
    at, acc = _judged(s, d)
    return E.displacement(_lexical_top(s, d, at), acc, tests)


@query("is_test_pred", f"WITH {UNITS} SELECT DISTINCT p AS path, is_test FROM (SELECT {_TESTPATH} AS p, language = 'fr' AS is_test FROM units UNION ALL SELECT * FROM (VALUES ('a/test_x.py', true), ('a/x_test.go', true), ('contest/x.py', false), ('a/testdata/x', true), ('tests', false)) v(p, t))")
def is_test_pred(s, d):
    u = C.units(C.table(s, d, "documents")).select(F.when(F.col("language") == "fr", F.concat(F.lit("tests/"), "path")).otherwise(F.col("path")).alias("path"))
    more = s.createDataFrame([("a/test_x.py",), ("a/x_test.go",), ("contest/x.py",), ("a/testdata/x",), ("tests",)], "path string")
    return u.unionByName(more).distinct().select("path", E.is_test(F.col("path")).alias("is_test"))


@query("latency_spread", "SELECT event_type AS metric, round(median(value), 6) AS median, round(min(value), 6) AS low, round(max(value), 6) AS high FROM events GROUP BY event_type")
def latency_spread(s, d):
    g = C.table(s, d, "events").groupBy(F.col("event_type").alias("metric"))
    return g.agg(F.round(F.median("value"), 6).alias("median"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"))


@query("vector_share", "SELECT round((SELECT sum(4.0 * len(embedding)) FROM embeddings) / ((SELECT sum(4.0 * len(embedding)) FROM embeddings) + (SELECT sum(octet_length(encode(text))) FROM documents)), 6) AS share")
def vector_share(s, d):
    v = C.table(s, d, "embeddings").agg(F.sum(F.size("embedding") * 4.0).alias("v"))
    t = C.table(s, d, "documents").agg(F.sum(F.octet_length("text")).alias("t"))
    return v.crossJoin(t).select(F.round(F.col("v") / (F.col("v") + F.col("t")), 6).alias("share"))


