import json
import math
import os
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwell import config
from siftwell.functions import parse, text, vectors
from siftwell.operators import corpus, evaluate, graph, index, lines, ranking, snapshot, store
from siftwell.sources import index_store, patch, remote, synthetic, tree
from siftwell.streaming import session


def model_tokens(s):
    out = []
    for m in re.finditer(r"[A-Za-z_][A-Za-z0-9_]*|[一-鿿]+|\d+", s):
        w = m.group().lower()
        out.append(w)
        if "一" <= w[0] <= "鿿" and len(w) > 1:
            out += [w[i : i + 2] for i in range(len(w) - 1)]
    return out


def test_tokens_follow_the_model(spark):
    samples = ["", "读取 a", "读", "数据库x_1 22", "naïve Ünï ١٢ x", "A1b2_ 9z", "分词" * 3]
    df = spark.createDataFrame(list(enumerate(samples)), "i int, s string")
    got = {r["i"]: r["t"] for r in df.select("i", text.tokens(F.col("s")).alias("t")).collect()}
    assert got == {i: model_tokens(s) for i, s in enumerate(samples)}


def units_of(spark, rows):
    """rows: (name, body)."""
    u = [(f"{n}.py:1:{n}", f"{n}.py", "python", "function", n, n, f"def {n}():", f"This python function {n}.", b) for n, b in rows]
    return spark.createDataFrame(u, "unit_id string, path string, language string, kind string, name string, qualified_name string, signature string, description string, source string")


def search(spark, units, query, limit=8):
    q = spark.createDataFrame([(0, query)], "query_id long, query string")
    n = units.agg(F.count("*").alias("n"))
    at = ranking.probe(q, index.postings(units))
    ev = ranking.evidence(q, at, n).first()
    return ev, ranking.ranked(ranking.lexical(ranking.hits(at, n)).withColumnRenamed("lexical", "score"), limit).orderBy("rank").collect()


@pytest.fixture(scope="module")
def ledger(spark):
    rows = [(f"entry_{i}", f"return ledger balance account {i}") for i in range(220)] + [("walrus", "the zebra quokka narwhal okapi live here")]
    rows += [(f"part_{w}", f"ledger {w} balance") for w in ("fjord", "glacier", "tundra", "lagoon")]
    return units_of(spark, rows).persist()


def test_rare_word_wins(spark, ledger):
    ev, got = search(spark, ledger, "zebra quokka balance")
    assert ev["sufficient"] and got[0]["unit_id"].startswith("walrus")


@pytest.mark.parametrize(
    ("query", "reason"),
    [
        ("xylophone", "no_query_term_in_index"), ("ledger balance", "only_ubiquitous_terms_matched"), ("zebra xenon yttrium zinc", "too_little_of_the_query_matched"),
        ("fjord glacier tundra lagoon", "matched_terms_are_scattered"), ("zebra narwhal", ""),
    ],
)
def test_reasons(spark, ledger, query, reason):
    ev, _ = search(spark, ledger, query)
    assert ev["reason"] == reason and ev["sufficient"] == (reason == "")


def test_small_corpora_have_lower_bars(spark):
    ev, _ = search(spark, units_of(spark, [("alpha", "one two"), ("beta", "three four")]), "alpha unknown words here")
    assert ev["sufficient"]


def test_budget_keeps_the_first(spark):
    rows = spark.createDataFrame([(0, 1, 50), (0, 2, 5), (1, 1, 3), (1, 2, 4), (1, 3, 9)], "query_id long, rank long, size long")
    got = sorted((r["query_id"], r["rank"]) for r in ranking.within_budget(rows, 10).collect())
    assert got == [(0, 1), (1, 1), (1, 2)]


def test_dominance(spark):
    rows = spark.createDataFrame([(0, 1, 1.0), (0, 2, 0.5), (1, 1, 0.7), (2, 1, 0.0)], "query_id long, rank long, score double")
    assert {r["query_id"]: r["dominance"] for r in ranking.dominance(rows).collect()} == {0: 0.5, 1: 1.0, 2: 0.0}


def test_hashed_vectors(spark):
    df = spark.createDataFrame([("a", "read the file 读取"), ("b", "")], "unit_id string, text string")
    got = {r["unit_id"]: r["vector"] for r in vectors.dense(vectors.sparse_vectors(df, 64), 64).collect()}
    assert got["a"] == pytest.approx(vectors.embed("read the file 读取", 64)) and "b" not in got
    assert math.isclose(sum(x * x for x in got["a"]), 1.0)
    with pytest.raises(ValueError, match="dimensions"):
        vectors.buckets(df.select(F.col("text").alias("term")), 16)


def test_neighbors_first_path_wins(spark):
    e = spark.createDataFrame([("a", "b", "calls", ""), ("a", "c", "calls", ""), ("b", "d", "calls", ""), ("c", "d", "calls", ""), ("a", "a", "calls", ""), ("e", "a", "imports", "")], "source string, target string, kind string, label string")
    s = spark.createDataFrame([("a",)], "start_id string")
    got = [(r["hop"], r["rank"], r["unit_id"], r["path"]) for r in graph.neighbors(e, s, 2).orderBy("hop", "rank").collect()]
    assert [g[:3] for g in got] == [(1, 1, "b"), (1, 2, "c"), (1, 3, "e"), (2, 1, "d")]
    assert got[3][3] == "a calls:a->b b calls:b->d d" and got[2][3] == "a imports:e->a e"
    assert graph.neighbors(e, s, 0).count() == 0


def test_call_resolution(spark):
    rows = [("x:1:f", "x.py", "f", "f", "", ["g", "self.h", "y.k", "os.k", "f"], []), ("x:2:h", "x.py", "h", "C.h", "C", [], []), ("y:1:g", "y.py", "g", "g", "", [], []), ("y:2:k", "y.py", "k", "k", "", [], []), ("z:1:g2", "z.py", "g2", "g2", "", [], ["pkg.y"]), ("x:3:C", "x.py", "C", "C", "", [], [])]
    u = spark.createDataFrame(rows, "unit_id string, path string, name string, qualified_name string, parent string, calls array<string>, imports array<string>")
    got = {(r["source"], r["target"], r["kind"]) for r in graph.build(u).collect()}
    assert got == {("x:1:f", "y:1:g", "calls"), ("x:1:f", "x:2:h", "calls"), ("x:1:f", "y:2:k", "calls"), ("x:3:C", "x:2:h", "contains"), ("z:1:g2", "y:1:g", "imports"), ("z:1:g2", "y:2:k", "imports")}


def test_malformed_edges(spark):
    df = spark.createDataFrame([('{"source":"a","target":"b","kind":"calls"}',), ("x",), ('{"source":"a"}',), ('{"source":"a","target":"a","kind":"calls"}',)], "line string")
    assert graph.from_json(df).count() == 1


def test_serials_are_stable(spark):
    u = spark.createDataFrame([("a", "p", 1, "a"), ("b", "p", 2, "b"), ("c", "q", 1, "c"), ("d", "q", 2, "d")], "unit_id string, path string, start_line int, qualified_name string")
    prev = spark.createDataFrame([("b", 7), ("c", 7), ("d", 0)], "unit_id string, serial long")
    assert {r["unit_id"]: r["serial"] for r in snapshot.stable_serials(u, prev).collect()} == {"b": 7, "a": 8, "c": 9, "d": 10}
    assert {r["unit_id"]: r["serial"] for r in snapshot.global_serials(u).collect()} == {"a": 1, "b": 2, "c": 3, "d": 4}


def test_spans_on_lines(spark):
    src = "class A {\n  f() {\n  }\n  g() { }\n}\nx() {\n"
    ln = lines.numbered(spark.createDataFrame([(1, src)], "d long, t string"), "d", F.col("t"))
    decl = lines.declarations(ln, "d", [("class", r"class (\w+)"), ("method", r"(\w+)\(\)")])
    deep = lines.depths(ln, "d", r"\{", r"\}")
    got = sorted((r["start_line"], r["end_line"]) for r in lines.closing_spans(decl, deep, "d").collect())
    assert got == [(1, 5), (2, 3), (4, 4)]


def test_description_tiers(spark):
    u = spark.createDataFrame([(f"u{i}", "p", f"n{i}", f"h{i}", f"c{i}") for i in range(6)], "unit_id string, path string, qualified_name string, hash string, code_hash string")
    e = spark.createDataFrame(
        [("u0", "p", "n0", "h0", "x", "zero"), ("old", "p", "m", "h1", None, "one"), ("u2", "p", "n2", "y", "c2", "two"), ("old3", "p", "m", "z", "c3", "three"), ("o4", "p", "m", "h4", None, "a"), ("o5", "p", "m", "h4", None, "b")],
        "unit_id string, path string, name string, hash string, code_hash string, text string",
    )
    got = {r["unit_id"]: (r["tier"], r["text"]) for r in store.applicable(u, e).collect()}
    assert got == {"u0": (1, "zero"), "u1": (2, "one"), "u2": (3, "two"), "u3": (4, "three")}


@settings(max_examples=20, deadline=None)
@given(st.sampled_from(["tests/x/*", "*.py", "a/b.py", "*::C.*"]), st.sampled_from(["tests/x/y", "a/tests/x/y", "a/b.py", "x/a/b.py", "a/b/c.py", "f.py::C.d"]))
def test_globs_match_as_paths_do(pattern, path):
    from pathlib import PurePosixPath

    assert bool(re.search(text.glob_regex(pattern), path)) == PurePosixPath(path).match(pattern)


PY = '''import os
from pkg import thing


class Box:
    """Holds things."""

    def put(self, x):
        """Puts  x in."""
        os.stat(x)
        self.check(x)


def free():
    return thing.call()
'''


def test_python_units():
    got = {u["qualified_name"]: u for u in parse.python_units("m.py", PY)}
    assert list(got) == ["Box", "Box.put", "free"]
    assert got["Box.put"]["calls"] == ["os.stat", "self.check"] and got["Box.put"]["imports"] == ["os", "pkg"]
    assert got["Box.put"]["kind"] == "function" and "method put" in got["Box.put"]["description"] and "Puts x in" in got["Box.put"]["description"]
    assert parse.python_units("m.py", "def (:")[0]["code"] == "syntax_error"
    assert parse.parse_one("m.py", b"\xff")[0]["code"] == "decode_error"


@pytest.mark.parametrize(
    ("path", "source", "names"),
    [
        ("a.go", "// Sums up.\nfunc Sum(a int) int {\n\treturn a\n}\ntype T struct {\n}\n", ["Sum", "T"]),
        ("a.rs", "pub fn run() {\n  let s = \"}\";\n}\nstruct S;\n", ["run", "S"]),
        ("a.js", "export function f(a) {\n}\nconst g = (x) => x;\nconst h = (x) => {\n};\nclass K {\n}\n", ["f", "h", "K"]),
        ("a.rb", "class A\n  def b\n    1\n  end\nend\n", ["A", "b"]),
        ("a.java", "public class A {\n  public int f(int x) {\n    return x;\n  }\n}\n", ["A", "f"]),
        ("a.sh", "run() {\n  cat <<EOF\nfake() {\nEOF\n}\n", ["run"]),
        ("a.c", "int add(int a, int b) {\n  return a + b;\n}\nint later(int a);\n", ["add"]),
    ],
)
def test_other_languages(path, source, names):
    assert [u["name"] for u in parse.parse_one(path, source.encode())] == names


def test_comment_lines_are_cleaned():
    above = ["/**", " * Charges an invoice,", " * once.", " * @param id the invoice to charge", " * x = y;", " * -----", " */", "@Override", "#[inline]"]
    assert parse.comment_above([*above, "f() {"], len(above), "java") == "Charges an invoice, once. id the invoice to charge"
    assert parse.comment_above(["// far", "", "f() {"], 2, "java") == ""
    assert parse.comment_above([f"// w{i}" for i in range(30)] + ["f() {"], 30, "go") == " ".join(f"w{i}" for i in range(10, 30))


def test_doc_comment_is_kept():
    (u, *_) = parse.parse_one("a.go", b"// Sums up\n// all values.\nfunc Sum(a int) int {\n\treturn a\n}\n")
    assert "Documented intent: Sums up all values." in u["description"] and (u["start_line"], u["end_line"]) == (3, 5)


@pytest.fixture(scope="module")
def checkout(tmp_path_factory):
    d = tmp_path_factory.mktemp("tree")
    for p, t in {"pkg/__init__.py": "def boot():\n    return load()\n", "pkg/io.py": PY, ".hidden/x.py": "def no(): pass\n", "dist/y.py": "def no(): pass\n", "bad.py": "def (\n", ".dot.py": "def dotted(): pass\n", "n.txt": "x"}.items():
        (d / p).parent.mkdir(parents=True, exist_ok=True)
        (d / p).write_text(t)
    (d / "big.py").write_text("#" * 2001)
    os.symlink(d / "pkg/io.py", d / "link.py")
    return str(d)


def test_tree_to_published_index(spark, checkout, tmp_path):
    cfg = config.defaults().overridden(index__max_file_bytes=2000)
    files = tree.read_tree(spark, checkout, cfg)
    assert sorted(r["path"] for r in files.select("path").collect()) == [".dot.py", "bad.py", "pkg/__init__.py", "pkg/io.py"]
    assert {r["sha256"] for r in tree.read_tree(spark, checkout, cfg, content=False).collect()} == {None}
    parsed = parse.parse_files(files).persist()
    units = parse.units_of(parsed)
    assert parse.diagnostics_of(parsed).first()["code"] == "syntax_error"
    root = str(tmp_path / "index")
    first = index_store.publish(root, units, graph.build(units), None, {"dimensions": 64})
    v = vectors.dense(vectors.sparse_vectors(corpus.fields(units).select("unit_id", corpus.searchable_text().alias("text")), 64), 64)
    index_store.publish(root, units, graph.build(units), v, {"dimensions": 64})
    got = index_store.load(spark, root)
    assert got["degraded"] is None and got["units"].count() == 5 and got["meta"]["schema"] == 2
    with open(f"{root}/_CURRENT", "w") as f:
        f.write(first)
    assert index_store.load(spark, root)["degraded"] == "vector_store_unavailable"
    with open(f"{root}/_CURRENT", "w") as f:
        f.write("../../etc")
    with pytest.raises(ValueError, match="pointer"):
        index_store.load(spark, root)
    with open(f"{root}/_CURRENT", "w") as f:
        f.write(first)
    s = session.Session(spark, index_store.load(spark, root), checkout, monitor=session.StaleMonitor(lambda: False))
    assert s.reply("{")["error"] == "invalid_json" and s.reply("[1]")["error"] == "invalid_request"
    assert s.reply('{"action":"fly"}')["error"] == "unsupported action: fly"
    assert s.reply('{"action":"search","query":7}')["error"] == "invalid_request"
    hit = s.reply('{"action":"search","query":"put box things","limit":1e400}')
    assert hit["results"][0]["id"].startswith("pkg/io.py") and hit["stale"] is False
    assert s.reply('{"action":"stats"}')["units"] == 5
    assert s.reply('{"action":"open","path":"../x"}')["error"] == "path_outside_root"
    assert s.reply('{"action":"open","path":"pkg/io.py","start_line":1,"end_line":2}')["source"].startswith("import os")
    assert "results" in s.reply('{"action":"research","query":"put box things"}')
    assert "results" in s.reply(json.dumps({"action": "neighbors", "unit_id": hit["results"][0]["id"]}))


def test_requests_stream(spark, tmp_path):
    src, units = tmp_path / "in", units_of(spark, [("alpha", "one two"), ("beta", "three four")])
    src.mkdir()
    (src / "a.txt").write_text('{"id":"1","action":"search","query":"alpha one"}\nnope\n{"id":"2","action":"fly"}\n')
    q = session.serve(spark.readStream.text(str(src)), {"units": units, "postings": index.postings(units)}, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert q.exception() is None
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(str(r["error"]) for r in got) == ["None", "invalid_json", "unsupported action: fly"]
    assert any(r["results"] and "alpha" in r["results"] for r in got)


def test_stale_monitor_asks_once_a_second():
    calls, now = [], [0.0]
    m = session.StaleMonitor(lambda: calls.append(1) or True, 1.0, lambda: now[0])
    assert m.check() and m.check() and len(calls) == 1
    now[0] = 1.5
    assert m.check() and len(calls) == 2
    assert session.StaleMonitor(lambda: open("/no/such/file")).check()


@pytest.mark.parametrize(("raw", "want"), [(float("nan"), 8), (float("inf"), 100), (-5, 1), ("x", 8), (True, 8), (7.9, 7)])
def test_bounded(raw, want):
    assert session.bounded(raw, 8, 1, 100) == want


@pytest.mark.parametrize("bad", ["[search]\nlimit = 0", "[search]\nlimit = true", "[search]\nlimit = 1.5", "[search]\nnope = 1", "x = 1", "[embedding]\ndimensions = 16", "[embedding]\nprovider = 'z'", "[index]\nignore = 'x'", "[search]\nvector_weight = nan", "[search"])
def test_bad_settings(bad):
    with pytest.raises(config.ConfigError):
        config.from_text(bad)


def test_settings_round_trip():
    assert config.from_text(config.template()) == config.defaults() and len(config.SETTINGS) == 23
    t = config.updated("# top\n[search]\nlimit = 8  # few\n", "search.limit", 3)
    assert t == "# top\n[search]\nlimit = 3  # few\n"
    assert config.from_text(config.updated(t, "describe.batch", 5))["describe.batch"] == 5
    assert sum(s.build for s in config.SETTINGS.values()) == 7


def test_patch(spark):
    src = "def f():\n    return 1\n"
    ins = spark.createDataFrame([("a.py", 2, patch.docstring("Gives one.", "    "))], "path string, line int, lines array<string>")
    out = patch.render(ins, spark.createDataFrame([("a.py", src)], "path string, source string")).first()["patch"]
    assert '+    """Gives one."""' in out and out.startswith("--- a/a.py")
    assert patch.comment("Sums.", "", "go") == ["// Sums."] and patch.comment("x", "", "cobol") is None


def test_remote_replies():
    ok = {"data": [{"index": 1, "embedding": [0.0, 1.0]}, {"index": 0, "embedding": [1.0, 0.0]}]}
    assert remote.ordered(ok, 2, 2) == [[1.0, 0.0], [0.0, 1.0]]
    for bad in ({"data": []}, {"data": [{"index": 0, "embedding": [1.0]}]}, {"data": [{"index": 5, "embedding": [1.0, 2.0]}]}, {"data": [{"index": 0, "embedding": [float("nan"), 1.0]}]}):
        with pytest.raises(remote.ProviderError):
            remote.ordered(bad, 1, 2)
    with pytest.raises(remote.ProviderError):
        remote.checked_endpoint("http://example.com/v1", "key")


def test_synthetic_tree(spark):
    df = synthetic.functions(spark, 3, 4)
    assert df.count() == 12 and len(parse.python_units("m.py", df.first()["source"])) == 1


def test_grouping_sets(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 0.0), ("b", "x", 0.0)], "l string, k string, v double")
    got = {(r["dim"], r["value"]): r["m"] for r in evaluate.by_dimensions(df, ["l", "k"], [F.avg("v").alias("m")]).collect()}
    assert got[("all", "all")] == pytest.approx(1 / 3) and got[("l", "a")] == 0.5 and got[("k", "y")] == 0.0 and len(got) == 5
