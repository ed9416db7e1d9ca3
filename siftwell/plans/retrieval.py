"""Queries of the text, index, evidence, ranking and vector families, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.operators import corpus as C
from siftwell.operators import index as I
from siftwell.operators import ranking as R
from siftwell.operators.durable import durable

from .sqlkit import EVID, POST, QUERY, RANK, TF, UNITS, human, toks

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _units(s, d):
    return C.units(C.table(s, d, "documents"))


def _questions(s, d):
    return C.questions(C.table(s, d, "benchmark"))


def _n(s, d):
    return C.table(s, d, "documents").agg(F.count("*").alias("n"))


def _postings(s, d):
    return I.postings(_units(s, d))


# text


@query("tokenize", f"SELECT doc_id, CAST(unnest(range(1, len(t) + 1)) AS BIGINT) AS pos, unnest(t) AS term FROM (SELECT doc_id, {toks('text')} AS t FROM documents)")
def tokenize(s, d):
    t = C.table(s, d, "documents").select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("p", "term"))
    return t.select("doc_id", (F.col("p") + 1).cast("long").alias("pos"), "term")


MIXED = [(1, "读取文件 config_path2 v10"), (2, "图 one"), (3, "ABC数据库连接x9"), (4, "naïve ١٢٣ _x"), (5, ""), (6, "分词")]
_VALUES = ", ".join(f"({i}, '{x}')" for i, x in MIXED)


@query("tokenize_cjk", f"SELECT id, CAST(unnest(range(1, len(t) + 1)) AS BIGINT) AS pos, unnest(t) AS term FROM (SELECT CAST(id AS BIGINT) AS id, {toks('x')} AS t FROM (VALUES {_VALUES}) v(id, x))")
def tokenize_cjk(s, d):
    df = s.createDataFrame(MIXED, "id long, x string")
    return df.select("id", F.posexplode(T.tokens(F.col("x"))).alias("p", "term")).select("id", (F.col("p") + 1).cast("long").alias("pos"), "term")


@query("query_tokens", f"WITH {QUERY} SELECT query_id, term FROM qt")
def query_tokens(s, d):
    return R.query_terms(_questions(s, d))


@query("humanize", f"SELECT name, {human('name')} AS words FROM (SELECT DISTINCT event_type || 'Of' || upper(event_type) || '_User' || user_id AS name FROM events)")
def humanize(s, d):
    n = C.table(s, d, "events").select(F.concat("event_type", F.lit("Of"), F.upper("event_type"), F.lit("_User"), F.col("user_id").cast("string")).alias("name")).distinct()
    return n.select("name", T.humanized(F.col("name")).alias("words"))


@query("describe_sentence", f"WITH {UNITS} SELECT unit_id, description FROM units")
def describe_sentence(s, d):
    return _units(s, d).select("unit_id", "description")


_SERIAL = "row_number() OVER (ORDER BY path, doc_id, qualified_name, unit_id)"


@query(
    "embed_text",
    f"""WITH {UNITS}, s AS (SELECT *, {_SERIAL} AS serial FROM units)
SELECT unit_id, sha256('RAG[' || lpad(CAST(serial AS VARCHAR), CAST(greatest(5, length(CAST(serial AS VARCHAR))) AS INTEGER), '0') || '] ' || unit_id || ': ' || description || chr(10) || qualified_name || ' ' || kind || chr(10) || signature || chr(10) || description || chr(10)
  || 'calls: ' || chr(10) || 'imports: ' || chr(10) || source) AS sha256 FROM s""",
)
def embed_text(s, d):
    from siftwell.operators.snapshot import global_serials

    u = _units(s, d).withColumn("start_line", F.col("doc_id"))
    f = C.fields(u).join(global_serials(u), "unit_id")
    mark = F.format_string("RAG[%05d] %s: %s", F.col("serial"), F.col("unit_id"), F.col("description"))
    return f.select("unit_id", F.sha2(F.encode(F.concat(mark, F.lit("\n"), C.searchable_text()), "UTF-8"), 256).alias("sha256"))


@query("source_key", f"WITH {UNITS} SELECT unit_id, left(sha256(source), 16) AS digest FROM units")
def source_key(s, d):
    return _units(s, d).select("unit_id", T.source_key(F.col("source")).alias("digest"))


@query("source_half", "SELECT doc_id AS id, text AS head FROM documents UNION ALL SELECT CAST(i AS BIGINT), h FROM (VALUES (-1, 'Reads a file.'), (-2, '读取文件'), (-3, 'plain'), (-4, '')) v(i, h)")
def source_half(s, d):
    more = s.createDataFrame([(-1, "Reads a file.\n 读取文件 x"), (-2, "读取文件"), (-3, "plain"), (-4, "")], "id long, t string")
    rows = C.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("t")).unionByName(more)
    return rows.select("id", T.source_half(F.col("t")).alias("head"))


@query("snippet", f"WITH {UNITS} SELECT unit_id, sha256(regexp_replace(regexp_replace(array_to_string(string_split(source, chr(10))[2:4], chr(10)), '^\\s+', ''), '\\s+$', '')) AS text_sha FROM units")
def snippet(s, d):
    return _units(s, d).select("unit_id", F.sha2(F.encode(T.excerpt(F.col("source"), F.lit(2), F.lit(4)), "UTF-8"), 256).alias("text_sha"))


@query(
    "prose_lines",
    r"""SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, trim(l) <> '' AND regexp_matches(trim(l), '[A-Za-z]') AND NOT regexp_matches(trim(l), '^[-=*#~_/\\+ ]+$') AND NOT regexp_matches(trim(l), '[;{}]$') AS is_prose
FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))""",
)
def prose_lines(s, d):
    t = C.table(s, d, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("p", "l"))
    return t.select("doc_id", (F.col("p") + 1).cast("long").alias("line_no"), T.is_prose(F.col("l")).alias("is_prose"))


@query(
    "visible_description",
    """SELECT doc_id AS unit_id, CASE WHEN contains(regexp_replace(text, '\\s+', ' ', 'g'), regexp_replace(trim(regexp_replace(split_part(text, chr(10), 1), '\\s+', ' ', 'g')), '\\.$', '')) AND regexp_replace(trim(regexp_replace(split_part(text, chr(10), 1), '\\s+', ' ', 'g')), '\\.$', '') <> ''
  THEN 'This ' || lang || ' text.' ELSE 'This ' || lang || ' text. Documented intent: ' || split_part(text, chr(10), 1) END AS shown FROM documents""",
)
def visible_description(s, d):
    u = C.table(s, d, "documents")
    desc = F.concat(F.lit("This "), "lang", F.lit(f" text. {T.MARKER} "), F.substring_index("text", "\n", 1))
    return u.select(F.col("doc_id").alias("unit_id"), T.visible_description(desc, F.col("text")).alias("shown"))


@query(
    "wrap_text",
    r"""WITH RECURSIVE w AS (SELECT item_id AS id, list_filter(string_split_regex(trim(text), '\s+'), lambda x: x <> '') AS ws FROM benchmark),
r AS (
  SELECT id, ws, 1 AS i, 1 AS line_no, ws[1] AS line FROM w WHERE len(ws) > 0
  UNION ALL
  SELECT id, ws, i + 1, CASE WHEN length(line) + 1 + length(ws[i + 1]) <= 76 THEN line_no ELSE line_no + 1 END,
         CASE WHEN length(line) + 1 + length(ws[i + 1]) <= 76 THEN line || ' ' || ws[i + 1] ELSE ws[i + 1] END
  FROM r WHERE i < len(ws))
SELECT id, CAST(line_no AS BIGINT) AS line_no, arg_max(line, i) AS line FROM r GROUP BY id, line_no""",
)
def wrap_text(s, d):
    t = C.table(s, d, "benchmark").select(F.col("item_id").alias("id"), F.posexplode(T.wrapped(F.col("text"), 76)).alias("p", "line"))
    return t.select("id", (F.col("p") + 1).cast("long").alias("line_no"), "line")


@query("module_stem", "SELECT path, CASE WHEN regexp_matches(b, '^.+\\.[^.]*$') THEN regexp_extract(b, '^(.+)\\.[^.]*$', 1) ELSE b END AS stem FROM (SELECT DISTINCT url AS path, regexp_extract(url, '([^/]*)$', 1) AS b FROM pages UNION SELECT p, regexp_extract(p, '([^/]*)$', 1) FROM (VALUES ('a/b.c.py'), ('.hidden'), ('x/noext'), ('d.ir/f')) v(p))")
def module_stem(s, d):
    more = s.createDataFrame([("a/b.c.py",), (".hidden",), ("x/noext",), ("d.ir/f",)], "path string")
    p = C.table(s, d, "pages").select(F.col("url").alias("path")).unionByName(more).distinct()
    return p.select("path", T.module_stem(F.col("path")).alias("stem"))


@query("clamp_int", "SELECT event_id AS raw, CAST(CASE WHEN value IS NULL OR isnan(value) THEN 8 ELSE trunc(least(greatest(value, 1.0), 100.0)) END AS BIGINT) AS value FROM events")
def clamp_int(s, d):
    return C.table(s, d, "events").select(F.col("event_id").alias("raw"), T.clamp_int(F.col("value"), 8, 1, 100).alias("value"))


# index


@query("fields_unpivot", f"WITH {TF} SELECT unit_id, field, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars FROM fields")
def fields_unpivot(s, d):
    return C.long_fields(_units(s, d)).select("unit_id", "field", F.length("text").cast("long").alias("n_chars"))


@query("term_freq", f"WITH {TF} SELECT unit_id, field, term, CAST(tf AS BIGINT) AS tf FROM tf")
def term_freq(s, d):
    return I.term_freq(_units(s, d))


@query("field_avg_len", f"WITH {POST} SELECT field, round(avg_len, 6) AS avg_len FROM lens")
def field_avg_len(s, d):
    return I.field_avg_len(_units(s, d)).select("field", F.round("avg_len", 6).alias("avg_len"))


@query("bm25f_mass", f"WITH {POST} SELECT unit_id, term, round(mass, 6) AS mass FROM postings")
def bm25f_mass(s, d):
    return _postings(s, d).select("unit_id", "term", F.round("mass", 6).alias("mass"))


@query("doc_freq", f"WITH {EVID} SELECT term, CAST(df AS BIGINT) AS df FROM dfs")
def doc_freq(s, d):
    return I.doc_freq(_postings(s, d))


@query("idf", f"WITH {EVID} SELECT term, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM dfs, nn")
def idf(s, d):
    df = I.doc_freq(_postings(s, d)).crossJoin(F.broadcast(_n(s, d)))
    return df.select("term", F.round(I.idf(F.col("df"), F.col("n")), 6).alias("idf"))


@query("ubiquitous_terms", f"WITH {EVID} SELECT term, CAST(df AS BIGINT) AS df FROM dfs, nn WHERE df > greatest(0.05 * n, 8.0)")
def ubiquitous_terms(s, d):
    df = I.doc_freq(_postings(s, d)).crossJoin(F.broadcast(_n(s, d)))
    return df.where(I.is_ubiquitous(F.col("df"), F.col("n"))).select("term", "df")


@query("posting_lookup", f"WITH {EVID} SELECT query_id, term, unit_id, round(mass, 6) AS mass FROM qt JOIN postings USING (term)")
def posting_lookup(s, d):
    return _probe(s, d).found.withColumn("mass", F.round("mass", 6))


# evidence


def _probe(s, d):
    return R.scan(_questions(s, d), _units(s, d))


def _evidence(s, d):
    return R.evidence(_questions(s, d), _probe(s, d), _n(s, d))


@query("evidence_terms", f"WITH {EVID} SELECT query_id, term, CAST(df AS BIGINT) AS df, state FROM st")
def evidence_terms(s, d):
    return R.term_states(_probe(s, d), _n(s, d)).select("query_id", "term", "df", "state")


@query("evidence_coverage", f"WITH {EVID} SELECT query_id, CAST(considered AS BIGINT) AS considered, CAST(matched AS BIGINT) AS matched, round(coverage, 6) AS coverage FROM ev")
def evidence_coverage(s, d):
    return _evidence(s, d).select("query_id", F.col("considered").cast("long").alias("considered"), F.col("matched").cast("long").alias("matched"), F.round("coverage", 6).alias("coverage"))


@query("evidence_concentration", f"WITH {EVID} SELECT query_id, round(concentration, 6) AS concentration FROM ev")
def evidence_concentration(s, d):
    return _evidence(s, d).select("query_id", F.round("concentration", 6).alias("concentration"))


@query("evidence_gate", f"WITH {EVID} SELECT query_id, round(coverage, 6) AS coverage, round(concentration, 6) AS concentration, sufficient FROM ev")
def evidence_gate(s, d):
    return _evidence(s, d).select("query_id", F.round("coverage", 6).alias("coverage"), F.round("concentration", 6).alias("concentration"), "sufficient")


_REASON = """CASE WHEN sufficient THEN '' WHEN matched = 0 AND ubiquitous > 0 THEN 'only_ubiquitous_terms_matched' WHEN matched = 0 THEN 'no_query_term_in_index'
 WHEN coverage < 0.40 * scale THEN 'too_little_of_the_query_matched' ELSE 'matched_terms_are_scattered' END"""


_HINT = "CASE reason " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.HINTS.items()) + " ELSE '' END"


@query("diagnosis", f"""WITH {EVID}, r AS (SELECT *, {_REASON} AS reason FROM ev) SELECT query_id, reason, CAST(query_terms AS BIGINT) AS query_terms, CAST(matched AS BIGINT) AS matched_terms, CAST(ubiquitous AS BIGINT) AS ubiquitous_terms,
  round(coverage, 4) AS coverage, round(concentration, 4) AS concentration, round(0.40 * scale, 4) AS applied_min_coverage, round(0.28 * scale, 4) AS applied_min_concentration, {_HINT} AS hint FROM r""")
def diagnosis(s, d):
    n = _n(s, d)
    return R.diagnosed(R.evidence(_questions(s, d), _probe(s, d), n), n)


@query(
    "describe_nudge",
    f"""WITH {EVID}, m AS (SELECT count(*) AS missing FROM documents d ANTI JOIN labels l USING (doc_id))
SELECT query_id, CASE WHEN {_REASON} IN ('no_query_term_in_index', 'too_little_of_the_query_matched', 'matched_terms_are_scattered') AND missing > 0 THEN missing || ' units have no description yet' ELSE '' END AS nudge FROM ev, m""",
)
def describe_nudge(s, d):
    labels = C.table(s, d, "labels")
    missing = C.table(s, d, "documents").join(labels, "doc_id", "left_anti").agg(F.count("*").alias("missing"))
    e = _evidence(s, d).crossJoin(F.broadcast(missing))
    ask = F.col("reason").isin("no_query_term_in_index", "too_little_of_the_query_matched", "matched_terms_are_scattered") & (F.col("missing") > 0)
    return e.select("query_id", F.when(ask, F.concat(F.col("missing").cast("string"), F.lit(" units have no description yet"))).otherwise("").alias("nudge"))


# ranking


def _vectors(s, d):
    e = C.table(s, d, "embeddings")
    u = _units(s, d).select("unit_id", "doc_id").join(e, F.col("doc_id") == F.col("vec_id")).select("unit_id", F.col("embedding").alias("unit_vector"))
    q = _questions(s, d).join(e, F.col("query_id") == F.col("vec_id")).select("query_id", F.col("embedding").alias("query_vector"))
    return u, q


@query("bm25f_search", f"WITH {RANK} SELECT query_id, CAST(rank AS BIGINT) AS rank, unit_id, score FROM (SELECT query_id, unit_id, round(lexical, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(lexical, 6) DESC, unit_id) AS rank FROM lex)")
def bm25f_search(s, d):
    scores = _probe(s, d).lexical(_n(s, d)).withColumn("score", F.round("lexical", 6))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("unit_id"))
    return scores.select("query_id", F.row_number().over(w).cast("long").alias("rank"), "unit_id", "score")


@query("topk_search", f"WITH {RANK} SELECT query_id, CAST(rank AS BIGINT) AS rank, unit_id, score FROM (SELECT query_id, unit_id, round(lexical, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(lexical, 6) DESC, unit_id) AS rank FROM lex) WHERE rank <= 8")
def topk_search(s, d):
    return R.ranked(_probe(s, d).best(_n(s, d), R.LIMIT).withColumnRenamed("lexical", "score"))


def _hybrid(s, d, at=None):
    """The winners, LIMIT a question, written once: replies join them several times."""
    return durable(R.ranked(R.hybrid(_questions(s, d), at or _probe(s, d), _n(s, d), *_vectors(s, d), limit=R.LIMIT)))


@query("hybrid_search", f"WITH {RANK} SELECT * FROM top")
def hybrid_search(s, d):
    return _hybrid(s, d)


@query("matched_terms", f"WITH {RANK} SELECT t.query_id, t.unit_id, string_agg(qt.term, ' ' ORDER BY qt.term) AS terms FROM top t JOIN qt USING (query_id) JOIN postings p ON p.term = qt.term AND p.unit_id = t.unit_id GROUP BY t.query_id, t.unit_id")
def matched_terms(s, d):
    at = _probe(s, d)
    return R.matched_terms(_hybrid(s, d, at), at)


@query("selective_candidates", f"WITH {RANK} SELECT query_id, unit_id FROM sel")
def selective_candidates(s, d):
    return R.selective(_probe(s, d), _n(s, d))


_RECALL = """sims AS (SELECT qv.query_id, uv.unit_id, round(list_dot_product(CAST(uv.v AS DOUBLE[]), CAST(qv.v AS DOUBLE[])), 6) AS score FROM qv, uv)"""


@query(
    "vector_recall",
    f"""WITH {RANK}, {_RECALL},
r AS (SELECT s.*, row_number() OVER (PARTITION BY s.query_id ORDER BY score DESC, s.unit_id DESC) AS rank FROM sims s ANTI JOIN lex l ON l.query_id = s.query_id AND l.unit_id = s.unit_id)
SELECT query_id, CAST(rank AS BIGINT) AS rank, unit_id, score FROM r WHERE rank <= 50""",
)
def vector_recall(s, d):
    return R.nearest(_probe(s, d).hit_by(_n(s, d)), *_vectors(s, d)).withColumnRenamed("cos", "score")


@query(
    "semantic_search",
    f"""WITH {RANK}, {_RECALL},
near AS (SELECT s.*, row_number() OVER (PARTITION BY s.query_id ORDER BY score DESC, s.unit_id DESC) AS rn FROM sims s
  SEMI JOIN (SELECT query_id FROM ev WHERE sufficient) k ON k.query_id = s.query_id SEMI JOIN lex a ON a.query_id = s.query_id ANTI JOIN lex l ON l.query_id = s.query_id AND l.unit_id = s.unit_id),
both_ AS (SELECT query_id, unit_id, score FROM hyb UNION ALL SELECT query_id, unit_id, 0.15 * score FROM near WHERE rn <= 50 AND score > 0),
r AS (SELECT query_id, unit_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, unit_id) AS rank FROM both_)
SELECT query_id, CAST(rank AS BIGINT) AS rank, unit_id, score FROM r WHERE rank <= 8""",
)
def semantic_search(s, d):
    """With an embedder of real semantics, the nearest units without a word in common are
    candidates too."""
    return R.ranked(R.hybrid(_questions(s, d), _probe(s, d), _n(s, d), *_vectors(s, d), semantic=True, limit=R.LIMIT))


# questions in words that no document has: only with both bars at 0 do they pass the gate,
# and then vectors alone answer. The questions as they are pass as well, by their words.
_DISGUISED = "regexp_replace(text, '([A-Za-z0-9_]+)', 'zq\\1qz', 'g')"


@query(
    "cosine_fallback",
    f"""WITH {RANK.replace("FROM benchmark),", f"FROM benchmark UNION ALL SELECT -1 - item_id, {_DISGUISED} FROM benchmark),", 1)},
pass_ AS (SELECT query_id FROM ev WHERE query_terms > 0),
none_ AS (SELECT query_id FROM pass_ ANTI JOIN lex USING (query_id)),
av AS (SELECT q.query_id, e.embedding AS v FROM q JOIN embeddings e ON e.vec_id = CASE WHEN q.query_id < 0 THEN -1 - q.query_id ELSE q.query_id END SEMI JOIN none_ n ON n.query_id = q.query_id),
sc AS (SELECT av.query_id, uv.unit_id, round(0.15 * list_dot_product(CAST(uv.v AS DOUBLE[]), CAST(av.v AS DOUBLE[])), 6) AS score FROM av, uv WHERE list_dot_product(CAST(uv.v AS DOUBLE[]), CAST(av.v AS DOUBLE[])) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM sc)
SELECT query_id, CAST(rank AS BIGINT) AS rank, unit_id, score FROM r WHERE rank <= 8""",
)
def cosine_fallback(s, d):
    b = C.table(s, d, "benchmark")
    disguised = F.regexp_replace("text", "([A-Za-z0-9_]+)", "zq$1qz")
    q = C.questions(b).unionByName(b.select((-1 - F.col("item_id")).alias("query_id"), disguised.alias("query")))
    at = R.scan(q, _units(s, d))
    known = at.df.select("query_id").distinct()
    passed = R.evidence(q, at, _n(s, d), 0.0, 0.0).where("sufficient").select("query_id").join(known, "query_id", "left_anti")
    u, _ = _vectors(s, d)
    of = F.when(F.col("query_id") < 0, -1 - F.col("query_id")).otherwise(F.col("query_id"))
    v = passed.join(C.table(s, d, "embeddings"), of == F.col("vec_id")).select("query_id", F.col("embedding").alias("query_vector"))
    return R.ranked(R.fallback(u, v))


@query(
    "lexical_baseline",
    f"""WITH {UNITS}, {QUERY}, ut AS (SELECT unit_id, unnest(list_distinct({toks("concat_ws(chr(10), qualified_name || ' ' || kind, signature, description, 'calls: ' || chr(10) || 'imports: ', source)")})) AS term FROM units),
o AS (SELECT query_id, unit_id, count(*) AS c FROM qt JOIN ut USING (term) GROUP BY ALL),
n AS (SELECT query_id, count(*) AS k FROM qt GROUP BY query_id),
r AS (SELECT query_id, unit_id, round(CAST(c AS DOUBLE) / k, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(CAST(c AS DOUBLE) / k, 6) DESC, unit_id) AS rank FROM o JOIN n USING (query_id))
SELECT query_id, CAST(rank AS BIGINT) AS rank, unit_id, score FROM r WHERE rank <= 8""",
)
def lexical_baseline(s, d):
    q = R.query_terms(_questions(s, d))
    size = q.groupBy("query_id").agg(F.count("*").alias("k"))
    u = C.fields(_units(s, d)).select("unit_id", F.explode(F.array_distinct(T.tokens(C.searchable_text()))).alias("term"))
    o = u.join(R.small(q), "term").groupBy("query_id", "unit_id").agg(F.count("*").alias("c")).join(size, "query_id")
    return R.ranked(o.select("query_id", "unit_id", (F.col("c") / F.col("k")).alias("score")))


_BLOCK = "length(u.path) + length(u.description) + length(u.source) + 16"


@query(
    "within_budget",
    f"""WITH {RANK}, b AS (SELECT t.query_id, t.rank, t.unit_id, sum({_BLOCK}) OVER (PARTITION BY t.query_id ORDER BY t.rank) AS running FROM top t JOIN units u USING (unit_id))
SELECT query_id, rank, unit_id, CAST(running AS BIGINT) AS running FROM b WHERE running <= 12000 OR rank = 1""",
)
def within_budget(s, d):
    u = _units(s, d).select("unit_id", (F.length("path") + F.length("description") + F.length("source") + 16).cast("long").alias("size"))
    return R.within_budget(u.join(R.small(_hybrid(s, d)), "unit_id"), 12_000).select("query_id", "rank", "unit_id", "running")


@query(
    "omitted_for_budget",
    f"""WITH {RANK}, b AS (SELECT t.query_id, t.rank, sum({_BLOCK}) OVER (PARTITION BY t.query_id ORDER BY t.rank) AS running FROM top t JOIN units u USING (unit_id))
SELECT query_id, count(*) FILTER (running <= 12000 OR rank = 1) AS shown, count(*) FILTER (running > 12000 AND rank > 1) AS omitted_for_budget FROM b GROUP BY query_id""",
)
def omitted_for_budget(s, d):
    u = _units(s, d).select("unit_id", (F.length("path") + F.length("description") + F.length("source") + 16).cast("long").alias("size"))
    return R.omitted(u.join(R.small(_hybrid(s, d)), "unit_id"), 12_000)


@query("trace_projection", f"WITH {RANK} SELECT t.query_id, t.rank, t.unit_id AS id, t.score, string_agg(qt.term, ' ' ORDER BY qt.term) AS matched_terms FROM top t JOIN qt USING (query_id) JOIN postings p ON p.term = qt.term AND p.unit_id = t.unit_id GROUP BY ALL")
def trace_projection(s, d):
    """A search's step as a trace: ids, scores and words, without any source."""
    at = _probe(s, d)
    top = _hybrid(s, d, at)
    return top.join(R.matched_terms(top, at), ["query_id", "unit_id"]).select("query_id", "rank", F.col("unit_id").alias("id"), "score", F.col("terms").alias("matched_terms"))


@query(
    "dominance",
    f"""WITH {RANK} SELECT query_id, round(CASE WHEN coalesce(a, 0) = 0 THEN 0.0 WHEN b IS NULL THEN 1.0 ELSE (a - b) / a END, 6) AS dominance
FROM (SELECT query_id, max(score) FILTER (rank = 1) AS a, max(score) FILTER (rank = 2) AS b FROM top GROUP BY query_id)""",
)
def dominance(s, d):
    return R.dominance(_hybrid(s, d)).select("query_id", F.round("dominance", 6).alias("dominance"))


@query(
    "context_block",
    f"""WITH {RANK}, b AS (SELECT t.*, u.path, u.description, u.source, sum({_BLOCK}) OVER (PARTITION BY t.query_id ORDER BY t.rank) AS running FROM top t JOIN units u USING (unit_id))
SELECT query_id, CAST(length(string_agg(path || ' (score ' || printf('%.3f', score) || ')' || chr(10) || description || chr(10) || source, chr(10) || chr(10))) AS BIGINT) AS n_chars
FROM b WHERE running <= 12000 OR rank = 1 GROUP BY query_id""",
)
def context_block(s, d):
    u = _units(s, d)
    size = (F.length("path") + F.length("description") + F.length("source") + 16).cast("long")
    rows = R.within_budget(u.withColumn("size", size).join(R.small(_hybrid(s, d)), "unit_id"), 12_000)
    block = F.concat("path", F.format_string(" (score %.3f)\n", "score"), "description", F.lit("\n"), "source")
    # at most LIMIT blocks a query
    g = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("x"))
    return g.select("query_id", F.length(F.array_join(F.transform("x", lambda x: x["b"]), "\n\n")).cast("long").alias("n_chars"))


@query("result_projection", f"WITH {RANK} SELECT t.query_id, t.rank, u.path, u.doc_id AS start_line, t.score FROM top t JOIN units u USING (unit_id)")
def result_projection(s, d):
    u = _units(s, d).select("unit_id", "path", F.col("doc_id").alias("start_line"))
    return u.join(R.small(_hybrid(s, d)), "unit_id").select("query_id", "rank", "path", "start_line", "score")


# vectors


@query(
    "cosine_pairs",
    """SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cos
FROM (SELECT * FROM embeddings SEMI JOIN benchmark ON vec_id = item_id) a, embeddings b WHERE a.vec_id <> b.vec_id""",
)
def cosine_pairs(s, d):
    """The questions' vectors against all."""
    e = C.table(s, d, "embeddings")
    q = e.join(C.table(s, d, "benchmark"), F.col("vec_id") == F.col("item_id"), "left_semi").select(F.col("vec_id").alias("left_id"), F.col("embedding").alias("a"))
    j = e.join(R.small(q, 10_000), (F.col("left_id") != F.col("vec_id")) & (F.size("a") == F.size("embedding")))
    return j.select("left_id", F.col("vec_id").alias("right_id"), F.round(R.cosine(F.col("a"), F.col("embedding")), 6).alias("cos"))


@query("vector_roundtrip_f32", "SELECT vec_id, round(list_max(list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x - CAST(CAST(x AS FLOAT) AS DOUBLE)))), 6) AS max_abs_err FROM embeddings")
def vector_roundtrip_f32(s, d):
    e = C.table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    err = F.zip_with("v", F.col("v").cast("array<float>").cast("array<double>"), lambda a, b: F.abs(a - b))
    return e.select("vec_id", F.round(F.array_max(err), 6).alias("max_abs_err"))


@query("hash_bucket", None)
def hash_bucket(s, d):
    from siftwell.functions.vectors import buckets

    return buckets(I.doc_freq(_postings(s, d)).select("term"), 384)


@query("feature_hash", None)
def feature_hash(s, d):
    from siftwell.functions.vectors import sparse_vectors

    return sparse_vectors(C.fields(_units(s, d)).select("unit_id", C.searchable_text().alias("text")), 384).withColumn("value", F.round("value", 6))

