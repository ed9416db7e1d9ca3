"""The pipeline's stages one after the other, against plain versions of each."""

import collections
import os
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as C
from siftwell.llm import catalog, langid, neardup, pii

DIR = "/root/testdata/sf0.001"
TOK = Tokenizer.from_file(catalog.public_file("byte_bpe_50k.json"))


def staged(spark, docs, folder):
    """The rows behind each stage."""
    out = []
    for name, stage in C.STAGES:
        stage(spark, docs, DIR).write.parquet(f"file://{folder}/{name}")
        docs = spark.read.parquet(f"file://{folder}/{name}")
        out.append(docs.collect())
    return out


def plain_components(texts, width=5, percent=80):
    sets = [neardup.shingles(neardup.words_of(t or ""), width) for t in texts]
    by, parent = collections.defaultdict(set), list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for x in s:
            by[x].add(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in by[x] if j < i}:
            if 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def test_stages_equal_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    known, single, masked, packed = staged(spark, docs, tmp_path)
    # language ID: every text by itself, with the same model
    scorer = langid.Scorer(langid.fit(docs))
    want = {}
    for i, r in rows.items():
        (lang,), (score,) = langid.identify([r["text"] or ""], scorer)
        if lang != "und" and score >= 0.3:
            want[i] = lang
    assert {r["doc_id"]: r["lang"] for r in known} == want and all(r["text"] == rows[r["doc_id"]]["text"] for r in known)
    # near-duplicates: all pairs that share a shingle; the smallest id stays
    ids = sorted(want)
    of = plain_components([rows[i]["text"] for i in ids])
    assert {r["doc_id"] for r in single} == {ids[i] for i in set(of)} and len(single) < len(known)
    # personal data: no promoted identifiers in these rows, so the base spans are masked
    assert {r["doc_id"]: r["text"] for r in masked} == {r["doc_id"]: pii.masked(r["text"], pii.find(r["text"])) for r in single}
    assert all(r["n_chars"] == len(r["text"]) and not pii.find(r["text"]) for r in masked if r["text"] != rows[r["doc_id"]]["text"])
    # packing: each document's ids once and in order, no gaps, nothing over the limit
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in packed:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == {r["doc_id"] for r in masked}
    for r in masked:
        ids, at = TOK.encode(r["text"], add_special_tokens=False).ids + [1], 0
        for p in sorted(by_doc[r["doc_id"]], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(struct.pack(f"<{p['length']}I", *ids[p["start"] : at]))
        assert at == len(ids)
    for cells in by_seq.values():
        assert all(a[0] + a[1] == b[0] for a, b in zip(sorted(cells), sorted(cells)[1:], strict=False)) and sum(n for _, n in cells) <= 2048


def test_run_keeps_the_last_stage_alone(spark):
    from siftwell.llm import common

    got = C.run(spark, DIR)
    (file, *_) = got.inputFiles()
    assert got.count() > 0 and got.columns[:3] == ["doc_id", "start", "length"] and "3-pack" in file
    folder = file.removeprefix("file://").split("/3-pack")[0]
    assert common.shared_dir(spark).removeprefix("file:").lstrip("/") in folder
    assert [x for x in os.listdir(folder) if not x.startswith(".")] == ["3-pack"]


WORDS = "the quick brown fox jumps over lazy dogs while rain falls on old roofs and nobody sings a song about it".split()


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows_go_through_all_stages(spark, docs_schema, tmp_path, empty):
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows = [(i, prose(60), "en", "s", 0) for i in range(30)]
    twin = prose(80)
    rows += [(40, twin, "en", "s", 0)] * 3 + [(41, twin + " indeed", None, None, None), (42, None, None, None, None), (43, "", "en", "s", 0), (44, " \t", "en", "s", 0), (None, prose(50), "en", "s", 0)]
    rows += [(45, "12345 67890", "en", "s", 0), (46, prose(20_000), "en", "s", 0), (47, f"{prose(30)} mail me@example.org now", "en", "s", 0)]
    docs = spark.createDataFrame(rows, docs_schema).withColumns({c: F.lit("clash") for c in ("th", "nid", "label", "h1", "rank", "_doc", "spans", "length")})
    known, single, masked, packed = staged(spark, docs.where("false") if empty else docs, tmp_path)
    if empty:
        assert not known and not single and not masked and not packed
        return
    gone = {42, 43, 44, 45}
    assert sorted(str(r["doc_id"]) for r in known) == sorted(str(r[0]) for r in rows if r[0] not in gone)
    assert sorted(str(r["doc_id"]) for r in single) == sorted({str(r[0]) for r in rows} - {str(i) for i in gone | {41}})
    assert "me@example.org" not in next(r["text"] for r in masked if r["doc_id"] == 47)
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in single} and len(packed) > len(single)
