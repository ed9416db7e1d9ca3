"""The operators' registered queries, with production parameters over whole tables."""

from __future__ import annotations

from . import htmltext, langid, neardup, packing, pieces, pii, secrets, topk, warc, weighted
from .common import table


def public_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark, sf_dir):
    return pieces.encode(table(spark, sf_dir, "documents"), public_file("piece_bpe_32k.model"))


def op2_warc(spark, sf_dir):
    got = warc.round_trip(table(spark, sf_dir, "pages"))
    return got.drop("archive", "frame", "record_id", "refers_to_id")


def op3_fingerprints(spark, sf_dir):
    return weighted.fingerprints(table(spark, sf_dir, "documents"))


def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op5_near_duplicates(spark, sf_dir):
    return neardup.group(table(spark, sf_dir, "documents"))


def op6_secrets(spark, sf_dir):
    return secrets.detect(table(spark, sf_dir, "documents"))


def op7_pii(spark, sf_dir):
    return pii.detect(table(spark, sf_dir, "documents"))


def op8_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op9_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_file("byte_bpe_50k.json"))


def op10_html_text(spark, sf_dir):
    return htmltext.main_text(table(spark, sf_dir, "pages"))


def queries() -> dict:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_warc": op2_warc,
        "op3_fingerprints": op3_fingerprints,
        "op4_language_id": op4_language_id,
        "op5_near_duplicates": op5_near_duplicates,
        "op6_secrets": op6_secrets,
        "op7_pii": op7_pii,
        "op8_top_k": op8_top_k,
        "op9_packing": op9_packing,
        "op10_html_text": op10_html_text,
    }


OP2_SQL = """
WITH p AS (SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to, url
FROM f
"""

OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s)
SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, score FROM r WHERE rn <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op8_top_k": OP8_SQL}
