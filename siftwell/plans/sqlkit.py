"""Shared pieces of the independent SQL (DuckDB)."""

RX = r"[A-Za-z_][A-Za-z0-9_]*|[\x{4e00}-\x{9fff}]+|\p{Nd}+"


def toks(x: str) -> str:
    """List of tokens of a text expression."""
    return (
        f"flatten(list_transform(regexp_extract_all({x}, '{RX}'), lambda w: CASE WHEN regexp_matches(w, '^[\\x{{4e00}}-\\x{{9fff}}]') AND length(w) > 1 "
        f"THEN list_concat([w], list_transform(range(1, length(w)), lambda i: substr(w, i, 2))) ELSE [lower(w)] END))"
    )


def human(x: str) -> str:
    w = f"trim(regexp_replace(lower(replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '_', ' ')), '\\s+', ' ', 'g'))"
    return f"CASE WHEN {w} = '' THEN 'anonymous unit' ELSE {w} END"


UNITS = f"""units AS (
  SELECT source || ':' || doc_id AS unit_id, source || '/' || lang || '.txt' AS path, lang AS language, 'document' AS kind,
         'doc_' || doc_id AS name, source || '.doc_' || doc_id AS qualified_name, left(split_part(text, chr(10), 1), 500) AS signature,
         'This ' || lang || ' document ' || ({human("'doc_' || doc_id")}) || '. Declared as: ' || left(split_part(text, chr(10), 1), 500) AS description,
         text AS source, doc_id
  FROM documents)"""

FIELDS = """fields AS (
  SELECT unit_id, 'name' AS field, 8.0 AS weight, concat_ws(' ', qualified_name, kind) AS text FROM units
  UNION ALL SELECT unit_id, 'signature', 4.0, signature FROM units
  UNION ALL SELECT unit_id, 'description', 3.0, description FROM units
  UNION ALL SELECT unit_id, 'relations', 2.0, 'calls: ' || chr(10) || 'imports: ' FROM units
  UNION ALL SELECT unit_id, 'body', 1.0, source FROM units)"""

TF = f"""{UNITS}, {FIELDS},
ft AS (SELECT unit_id, field, weight, {toks('text')} AS toks FROM fields),
tf AS (SELECT unit_id, field, term, count(*) AS tf FROM (SELECT unit_id, field, unnest(toks) AS term FROM ft) GROUP BY ALL)"""

POST = f"""{TF},
nn AS (SELECT count(*) AS n FROM units),
lens AS (SELECT field, CASE WHEN sum(len(toks)) = 0 THEN 1.0 ELSE CAST(sum(len(toks)) AS DOUBLE) / (SELECT n FROM nn) END AS avg_len FROM ft GROUP BY field),
postings AS (
  SELECT tf.term, tf.unit_id, sum(ft.weight / (0.25 + 0.75 * len(ft.toks) / lens.avg_len) * tf.tf) AS mass
  FROM tf JOIN ft USING (unit_id, field) JOIN lens USING (field) GROUP BY tf.term, tf.unit_id)"""

QUERY = f"""q AS (SELECT item_id AS query_id, text AS query FROM benchmark),
qt AS (SELECT DISTINCT query_id, unnest({toks('query')}) AS term FROM q)"""

EVID = f"""{POST}, {QUERY},
dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
st AS (
  SELECT qt.query_id, qt.term, coalesce(dfs.df, 0) AS df, n,
         CASE WHEN coalesce(dfs.df, 0) > greatest(0.05 * n, 8.0) THEN 'ubiquitous' WHEN dfs.df IS NULL THEN 'absent' ELSE 'matched' END AS state
  FROM qt LEFT JOIN dfs USING (term), nn),
per AS (
  SELECT query_id, count(*) AS query_terms, count(*) FILTER (state <> 'ubiquitous') AS considered, count(*) FILTER (state = 'matched') AS matched,
         count(*) FILTER (state = 'ubiquitous') AS ubiquitous,
         sum(CASE state WHEN 'matched' THEN ln(1 + (n - df + 0.5) / (df + 0.5)) WHEN 'absent' THEN ln(1 + (n - 0.5) / 1.5) ELSE 0 END) AS budget
  FROM st GROUP BY query_id),
held AS (
  SELECT query_id, max(s) AS held FROM (
    SELECT st.query_id, p.unit_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5))) AS s
    FROM st JOIN postings p USING (term) WHERE state = 'matched' GROUP BY 1, 2) GROUP BY query_id),
ev0 AS (
  SELECT q.query_id, coalesce(query_terms, 0) AS query_terms, coalesce(considered, 0) AS considered, coalesce(matched, 0) AS matched,
         coalesce(ubiquitous, 0) AS ubiquitous,
         CASE WHEN considered > 0 THEN CAST(matched AS DOUBLE) / considered ELSE 0.0 END AS coverage,
         CASE WHEN considered > 0 AND budget > 0 THEN coalesce(held, 0.0) / budget ELSE 0.0 END AS concentration, least(1.0, n / 200.0) AS scale
  FROM q LEFT JOIN per USING (query_id) LEFT JOIN held USING (query_id), nn),
ev AS (SELECT *, query_terms > 0 AND coverage >= 0.40 * scale AND concentration >= 0.28 * scale AS sufficient FROM ev0)"""

RANK = f"""{EVID},
hits AS (
  SELECT qt.query_id, qt.term, p.unit_id, p.mass, d.df, ln(1 + (n - d.df + 0.5) / (d.df + 0.5)) AS idf, n
  FROM qt JOIN postings p USING (term) JOIN dfs d USING (term), nn),
ceil_ AS (SELECT query_id, sum(idf) * 2.2 AS ceiling FROM (SELECT DISTINCT query_id, term, idf FROM hits) GROUP BY query_id),
lex AS (SELECT query_id, unit_id, sum(idf * mass * 2.2 / (mass + 1.2)) / any_value(ceiling) AS lexical FROM hits JOIN ceil_ USING (query_id) GROUP BY query_id, unit_id),
tt AS (SELECT greatest(64, least(2048, floor(n / 10))) AS t FROM nn),
rare AS (SELECT DISTINCT query_id, unit_id FROM hits, tt WHERE df <= t),
few AS (SELECT query_id FROM hits, tt GROUP BY query_id, t HAVING min(df) > t AND count(DISTINCT unit_id) <= t),
sel AS (SELECT * FROM rare UNION ALL SELECT DISTINCT query_id, unit_id FROM hits SEMI JOIN few USING (query_id)),
uv AS (SELECT u.unit_id, e.embedding AS v FROM units u JOIN embeddings e ON e.vec_id = u.doc_id),
qv AS (SELECT q.query_id, e.embedding AS v FROM q JOIN embeddings e ON e.vec_id = q.query_id),
hyb AS (
  SELECT l.query_id, l.unit_id,
         l.lexical + 0.15 * greatest(0.0, coalesce(list_dot_product(CAST(uv.v AS DOUBLE[]), CAST(qv.v AS DOUBLE[])), 0.0)) AS score
  FROM lex l SEMI JOIN (SELECT query_id FROM ev WHERE sufficient) s ON s.query_id = l.query_id
  LEFT JOIN sel ON sel.query_id = l.query_id AND sel.unit_id = l.unit_id
  LEFT JOIN uv ON uv.unit_id = sel.unit_id LEFT JOIN qv ON qv.query_id = sel.query_id),
top AS (
  SELECT query_id, CAST(rank AS BIGINT) AS rank, unit_id, score FROM (
    SELECT query_id, unit_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, unit_id) AS rank FROM hyb)
  WHERE rank <= 8)"""
