"""Every operator on nulls, empty and long texts, repeats, empty tables, clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

from siftwell.llm import catalog, htmltext, langid, neardup, packing, pieces, pii, secrets, topk, warc, weighted

CLASH = ["th", "n", "nid", "sig", "spans", "k", "term", "rank", "label", "_id", "head", "held_out", "score", "dk", "copy", "occ", "salt", "url2"]
PIECE, BPE = catalog.public_file("piece_bpe_32k.model"), catalog.public_file("byte_bpe_50k.json")
LONG = " ".join(random.Random(5).choice(["alpha", "beta", "gamma.", "x1", "\n"]) for _ in range(60_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 3),
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 3),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \t\n ", None, "b", 4),
    (5, LONG, "en", "b", 9),
    (6, "a" * 50_000, "de", "b", 9),
    (None, "no id here", "en", None, 1),
    (7, "le chat est sur la table", "fr", "a", 5),
    (7, "another text of the same id", "fr", "a", 5),
]


@pytest.fixture(scope="module")
def docs(spark, docs_schema):
    df = spark.createDataFrame(ROWS, docs_schema)
    return df.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


OPS = {
    "pieces": lambda d: pieces.encode(d, PIECE),
    "fingerprints": weighted.fingerprints,
    "langid": lambda d: langid.predict(d, langid.fit(d)),
    "neardup": neardup.group,
    "secrets": secrets.detect,
    "pii": pii.detect,
}


@pytest.mark.parametrize("name", list(OPS))
def test_a_row_for_each_document(docs, none, name):
    got = OPS[name](docs).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in ROWS)
    twins = [r for r in got if r["doc_id"] == 1]
    assert twins[0] == twins[1]
    assert OPS[name](none).collect() == []


def test_packing_places_every_row(docs, none):
    got = packing.pack(docs, BPE).collect()
    assert {r["doc_id"] for r in got} == {r[0] for r in ROWS}
    assert sum(r["start"] == 0 for r in got) == len(ROWS)
    assert packing.pack(none, BPE).collect() == []


def test_kept_columns(docs, none):
    model = langid.fit(docs)
    assert langid.label(docs, model).columns == docs.columns
    assert neardup.deduplicated(docs).columns == docs.columns
    assert pii.redact(docs).columns == docs.columns
    assert langid.label(none, model).count() == neardup.deduplicated(none).count() == pii.redact(none).count() == 0


PAGES = [(1, "http://a/x", "<p>" + "word " * 50), (1, "http://a/x", "<p>" + "word " * 50), (2, None, None), (3, "u\r\nx", ""), (None, "n", "<p>" + "word " * 50), (4, "e", "<" * 3000)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("payload_bytes", "deal", "text", "n_chars", "refers_to", "firsts")})


def test_pages(pages):
    got = warc.round_trip(pages).collect()
    assert sorted(str(r["page_id"]) for r in got) == sorted(str(r[0]) for r in PAGES)
    ones = sorted(r["record_type"] for r in got if r["page_id"] == 1)
    assert ones == ["response", "revisit"]
    assert htmltext.main_text(pages).count() == len(PAGES)
    empty = pages.where("false")
    assert warc.round_trip(empty).count() == htmltext.main_text(empty).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (50, [0.25, -0.5]), (1, None), (2, []), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1e300, 1.0]), (7, [1.0, 2.0, 3.0]), (8, [1.0, 0.5]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("v", "dim", "shard", "block", "run", "ids", "rank")})
    got = topk.top_k(df).collect()
    zero = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == 0)
    assert [x[1] for x in zero] == [6, 8, 50]
    assert zero[0][2] == (1 << 63) - 1 and zero[1][2] == 256 * 256 + 128 * 128
    assert topk.top_k(df.where("false")).count() == 0
