"""Every action of the session, the rebuild, the description store and the embedders."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from siftwell import config
from siftwell.functions import embedders, parse
from siftwell.operators import describe, rebuild
from siftwell.operators import store as D
from siftwell.sources import index_store, remote
from siftwell.streaming import session

FILES = {
    "pay/charge.py": 'import retry\n\n\ndef charge_card(card, amount):\n    """Charge a card once."""\n    return gateway_send(card, amount)\n\n\ndef gateway_send(card, amount):\n    return post(card, amount)\n',
    "pay/refund.py": "def refund_invoice(invoice):\n    return gateway_send(invoice.card, -invoice.amount)\n",
    "web/cart.js": "// Adds one article to the basket.\nexport function addArticle(cart, article) {\n  return cart.concat(article);\n}\n",
    "broken.py": "def (\n",
}


@pytest.fixture()
def repo(tmp_path):
    for path, text in FILES.items():
        (tmp_path / "src" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / path).write_text(text)
    return str(tmp_path / "src"), str(tmp_path / "index")


CFG = config.defaults().overridden(embedding__dimensions=64)


def opened(spark, repo, cfg=CFG):
    rebuild.refresh(spark, *repo, cfg)
    return session.Session(spark, index_store.load(spark, repo[1]), repo[0], cfg=cfg, index_root=repo[1])


def test_every_action(spark, repo, tmp_path):
    s = opened(spark, repo)
    hit = s.reply('{"query":"charge card gateway"}')
    assert hit["results"][0]["id"].startswith("pay/charge.py") and hit["stale"] is False and hit["degraded"] is None
    assert "charge_card" in hit["context"] and hit["diagnosis"] is None and hit["results"][0]["matched_terms"]
    short = s.reply('{"action":"search","query":"charge card gateway amount","max_chars":150}')
    assert short["omitted_for_budget"] == len(short["results"]) - 1 > 0 and len(short["context"]) <= 150
    none = s.reply('{"action":"search","query":"quokka zeppelin"}')
    assert none["results"] == [] and none["diagnosis"]["reason"] == "no_query_term_in_index" and none["diagnosis"]["hint"]
    assert none["diagnosis"]["distinctive_terms"] == ["quokka", "zeppelin"] and none["diagnosis"]["applied_min_coverage"] < 0.4
    assert s.reply('{"action":"search","query":"charge","limit":0}')["results"] == []
    wide = s.reply('{"action":"search","query":"refund invoice","graph":true,"limit":5}')
    assert {r["id"].split(":")[0] for r in wide["results"]} == {"pay/refund.py", "pay/charge.py"}
    assert any(r["evidence"] for r in wide["results"])
    deep = s.reply('{"action":"research","query":"refund invoice card"}')
    assert deep["results"] and deep["stop_reason"] in ("high_confidence", "new_graph_evidence") and deep["steps"][0]["action"] == "search"
    near = s.reply(json.dumps({"action": "neighbors", "id": "pay/charge.py:9:gateway_send"}))
    assert near["id"].endswith("gateway_send") and {n["unit"]["qualified_name"] for n in near["neighbors"]} >= {"charge_card", "refund_invoice"}
    assert s.reply('{"action":"open","path":"web/cart.js","start_line":1,"end_line":1}')["source"].startswith("// Adds")
    stats = s.reply('{"action":"stats"}')
    assert (stats["units"], stats["files"], stats["warnings"], stats["described"], stats["index_behind"]) == (4, 3, 1, 0, False)
    assert stats["embedding"]["provider"] == "signed-feature-hash"

    boot = s.reply('{"action":"bootstrap","limit":2}')
    assert boot["next"]["action"] == "describe" and boot["next"]["rounds_at_this_batch_size"] == 2 and len(boot["batch"]["units"]) == 2
    assert boot["already_documented"] == 2 and "English" in boot["batch"]["guidance"]
    todo = s.reply('{"action":"describe_pending"}')
    assert todo["missing"] == 4 and todo["units"][0]["source"] and todo["units"][0]["generated_description"]
    ids = [u["id"] for u in todo["units"]]
    put = s.reply(json.dumps({"action": "describe_put", "descriptions": [{"id": ids[0], "text": "quokka settlement"}, {"id": "no", "text": "x"}, 7, {"id": ids[1], "text": " "}, {"id": ids[1], "text": "y" * 1001}]}))
    assert put["stored_ids"] == [ids[0]] and put["applied"] == 1 and put["reindex_required"] and put["remaining"] == 3
    assert [r["reason"] for r in put["rejected"]] == ["unknown_unit", "not_an_object", "empty", "too_long"] and put["rejected"][-1]["limit"] == 1000
    found = s.reply('{"query":"quokka settlement"}')
    assert found["results"][0]["id"] == ids[0] and s.reply('{"action":"stats"}')["index_behind"] is True
    assert s.reply('{"action":"stats"}')["stale"] is True  # the published index lacks the text
    again = s.reply('{"action":"refresh"}')
    assert again["incremental"] and again["described"] == 1 and again["parsed_files"] == 0
    assert s.reply('{"query":"quokka settlement"}')["results"][0]["id"] == ids[0] and s.reply('{"action":"stats"}')["stale"] is False
    assert s.reply('{"action":"describe_put","descriptions":5}')["error"] == "invalid_request"
    assert s.reply('{"action":"research","query":"x","dominance_threshold":"high"}')["error"] == "invalid_request"


def test_stream_answers_all_actions(spark, repo, tmp_path):
    s = opened(spark, repo)
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text('{"id":"1","query":"charge card"}\n[1]\n{"id":"2","action":"stats"}\n{"id":"3","action":"search","graph":true,"query":"refund invoice"}\n{"id":"4","action":"describe_pending"}\n')
    q = session.serve(spark.readStream.text(str(src)), s.index, str(tmp_path / "out"), str(tmp_path / "cp"), s)
    q.awaitTermination(180)
    assert q.exception() is None
    got = {r["id"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[None]["error"] == "invalid_request" and "charge" in got["1"]["results"]
    assert json.loads(got["2"]["reply"])["units"] == 4 and json.loads(got["3"]["reply"])["results"] and json.loads(got["4"]["reply"])["missing"] == 4


def test_incremental_rebuild(spark, repo):
    root, index = repo
    first = rebuild.refresh(spark, root, index, CFG)
    assert not first["incremental"] and first["indexed_units"] == 4 and first["warnings"] == 1
    before = {r["unit_id"]: r["serial"] for r in index_store.load(spark, index)["units"].collect()}
    with open(f"{root}/pay/refund.py", "a") as f:
        f.write("\n\ndef refund_all(invoices):\n    return [refund_invoice(i) for i in invoices]\n")
    second = rebuild.refresh(spark, root, index, CFG)
    assert second["incremental"] and second["parsed_files"] == 1 and second["indexed_units"] == 5 and second["warnings"] == 1
    got = index_store.load(spark, index)
    after = {r["unit_id"]: r["serial"] for r in got["units"].collect()}
    assert all(after[k] == v for k, v in before.items()) and max(after.values()) == 5
    assert got["vectors"].count() == 5 and not rebuild.is_stale(spark, root, got["meta"], got["files"], CFG)
    full = rebuild.refresh(spark, root, index, CFG, full=True)
    assert not full["incremental"] and index_store.load(spark, index)["meta"]["fingerprint"] == got["meta"]["fingerprint"]
    other = rebuild.refresh(spark, root, index, CFG.overridden(embedding__dimensions=32))
    assert other["rebuilt_for_inputs"] and other["parsed_files"] == 4


def test_store_keeps_what_lives(spark, repo):
    root, index = repo
    rebuild.refresh(spark, root, index, CFG)
    units = index_store.load(spark, index)["units"]
    entries, report = describe.put(units, describe.read_store(spark, root), CFG, [{"id": "web/cart.js:2:addArticle", "text": "puts goods into the basket"}])
    old = entries.select("unit_id", "hash", F.lit(None).cast("string").alias("code_hash"), "path", "name", "text")  # as an older store has it
    gone = spark.createDataFrame([("x.py:1:f", "0" * 16, None, "x.py", "f", "nothing left")], describe.ENTRY)
    kept = describe.saved(old.unionByName(gone), units)
    describe.write_store(kept, root)
    (e,) = describe.read_store(spark, root).collect()
    assert report["stored"] == 1 and e["code_hash"] and e["text"] == "puts goods into the basket"
    assert D.fingerprint(describe.read_store(spark, root)).first()[0] == D.fingerprint(kept).first()[0] != ""
    with open(f"{root}/{describe.STORE}", "w") as f:
        f.write("<<<<<<< not json")
    assert describe.read_store(spark, root).count() == 0 and D.fingerprint(describe.read_store(spark, root)).first()[0] == ""


def test_promotion_patch_applies(spark, repo):
    from siftwell.sources import patch

    root, index = repo
    rebuild.refresh(spark, root, index, CFG)
    units = index_store.load(spark, index)["units"]
    entries, _ = describe.put(units, describe.read_store(spark, root), CFG, [{"id": "pay/charge.py:9:gateway_send", "text": "Sends a payment. 发送"}, {"id": "pay/charge.py:4:charge_card", "text": "documented already"}])
    from siftwell.sources import tree

    files = tree.read_tree(spark, root, CFG).select("path", "content")
    plan = describe.insertions(units, entries, files)
    rows = plan.collect()
    assert [(r["path"], r["line"], r["lines"]) for r in rows] == [("pay/charge.py", 10, ['    """Sends a payment."""'])]
    text = files.select("path", F.col("content").cast("string").alias("source"))
    (p,) = patch.render(plan, text).collect()
    done = subprocess.run(["git", "apply", "-"], input=p["patch"], text=True, cwd=root, capture_output=True, check=False)
    assert done.returncode == 0, done.stderr
    with open(f"{root}/pay/charge.py") as f:
        assert '    """Sends a payment."""\n    return post' in f.read()
    assert describe.promotion(units, entries, plan)["insertions"] == 1


def test_code_only():
    a = 'def f():\n    """Doc."""\n    return 1\n'
    assert describe.code_only(a, "python") == "def f():\n    return 1\n" and describe.code_only(a, "go") == a
    assert describe.code_only('x = """', "python") == 'x = """'


def test_embedder_dispatch():
    assert embedders.embedder(config.defaults()).semantic is False
    far = config.defaults().overridden(embedding__provider="openai-compatible", embedding__endpoint="https://h/v1", embedding__model="m")
    assert embedders.embedder(far).semantic is True
    with pytest.raises(remote.ProviderError, match="endpoint is empty"):
        embedders.embedder(config.defaults().overridden(embedding__provider="openai-compatible"))
    with pytest.raises(remote.ProviderError, match="not installed"):
        embedders.embedder(config.defaults().overridden(embedding__provider="sentence-transformers", embedding__model="m"))


def test_remote_policy(monkeypatch):
    import io
    import urllib.error

    calls, waits = [], []

    def reply(code):
        def f(request, timeout):
            calls.append(code)
            if isinstance(code, int):
                raise urllib.error.HTTPError("u", code, "x", {}, None)
            return io.BytesIO(code)

        return f

    monkeypatch.setattr(remote.time, "sleep", waits.append)
    for code, n in ((401, 1), (503, 3), (b"no json", 1)):
        calls.clear()
        monkeypatch.setattr(remote.urllib.request, "urlopen", reply(code))
        with pytest.raises(remote.ProviderError):
            remote.embed_batch(["a"], "https://h", "m", "", 2, retries=2)
        assert len(calls) == n
    monkeypatch.setattr(remote.urllib.request, "urlopen", reply(json.dumps({"data": [{"index": 0, "embedding": [1, 2]}]}).encode()))
    assert remote.embed_batch(["a"], "https://h", "m", "", 2) == [[1.0, 2.0]]
    assert waits[-1] == 0 and 2 in waits


@pytest.mark.parametrize(
    ("path", "source", "want"),
    [
        ("a.ts", "class B {\n  constructor(\n    x: number,\n  ) {\n  }\n  async load<T>(id: string): Promise<T> {\n    go(id)\n  }\n}\nconst m = function (a) {\n}\nconst o = {\n  short(a) {\n  },\n};\n", ["B", "constructor", "load", "m", "short"]),
        ("a.cpp", "class S {\n  ~S() {\n  }\n};\nint S::area(int a) const {\n  return later(a);\n}\nenum class E {\n};\n", ["S", "~S", "area", "E"]),
        ("a.go", "func (t *T) Do() error {\n}\nvar h = func(a int) {\n}\n", ["Do", "h"]),
        ("a.rb", "run = ->(a) { a }\ndef x=(v)\nend\n", ["run", "x="]),
        ("a.php", "<?php\n$f = function($a) {\n};\nclass A {\n  public static function go() {\n  }\n}\n", ["f", "A", "go"]),
        ("a.swift", "struct P {\n  init?(a: Int) {\n  }\n  var area: Int {\n    return 1\n  }\n  var stored: Int = 2\n}\n", ["P", "init", "area"]),
        ("a.sh", "function deploy-all {\n  echo\n}\nmy.fn() {\n  echo\n}\n", ["deploy-all", "my.fn"]),
        ("a.java", "public class A {\n  public static <T extends Comparable<T>> List<T> sorted(List<T> x) {\n    return copy(x);\n  }\n  public void cont(\n      int a) {\n  }\n}\n", ["A", "sorted", "cont"]),
        ("a.kts", "data class A(val x: Int)\nfun String.toId(a: Int): Int {\n  return 1\n}\nenum class E {\n}\n", ["A", "toId", "E"]),
        ("a.cs", "public record struct R {\n  public async Task<string> Render(int a) {\n  }\n}\n", ["R", "Render"]),
        ("a.scala", "case class A(x: Int)\nobject B {\n  def go(x: Int): Int = {\n    x\n  }\n}\n", ["A", "B", "go"]),
    ],
)
def test_declarations_of_many_shapes(path, source, want):
    assert [u["name"] for u in parse.parse_one(path, source.encode())] == want


def test_command_line(spark, repo, capsys, monkeypatch, tmp_path):
    import io

    from siftwell.__main__ import main

    root, _ = repo
    run = lambda *a: main(list(a), spark)
    assert run("config", "init", "--root", root) == 0 and run("config", "init", "--root", root) == 1
    assert run("config", "set", "embedding.dimensions", "64", "--root", root) == 0
    capsys.readouterr()
    assert run("config", "get", "embedding.dimensions", "--root", root) == 0 and capsys.readouterr().out.strip() == "64"
    assert run("index", root) == 0
    assert json.loads(capsys.readouterr().out)["indexed_units"] == 4
    assert run("search", "charge card gateway", "--root", root, "--json", "--limit", "2") == 0
    assert json.loads(capsys.readouterr().out)["results"][0]["id"].startswith("pay/charge.py")
    assert run("annotate", "--root", root, "--output", str(tmp_path / "a.md")) == 0
    text = (tmp_path / "a.md").read_text()
    assert text.startswith("## pay/charge.py") and text.count("- RAG[0000") == 4
    (tmp_path / "in.json").write_text(json.dumps({"descriptions": [{"id": "web/cart.js:2:addArticle", "text": "basket"}]}))
    assert run("describe", "import", str(tmp_path / "in.json"), "--root", root) == 0
    capsys.readouterr()
    assert run("describe", "status", "--root", root) == 0 and json.loads(capsys.readouterr().out)["described"] == 1
    assert run("annotate", "--root", root) == 1  # the index lacks the description
    assert run("describe", "export", "--root", root, "--limit", "1") == 0
    capsys.readouterr()
    monkeypatch.setattr("sys.stdin", io.StringIO('{"action":"stats"}\n\nnope\n'))
    assert run("agent", "--root", root) == 0
    first, second = capsys.readouterr().out.strip().splitlines()
    assert json.loads(first)["units"] == 4 and json.loads(second)["error"] == "invalid_json"


def test_old_versions_go_and_postings_are_sorted(spark, repo):
    import os

    root, index = repo
    for _ in range(4):
        rebuild.refresh(spark, root, index, CFG, full=True)
    versions = [x for x in os.listdir(index) if x.startswith("v-")]
    assert sorted(int(v.rsplit("-", 1)[1]) for v in versions) == [3, 4]  # a reader may hold the one before
    os.makedirs(f"{index}/v-not-ours")
    rebuild.refresh(spark, root, index, CFG, full=True)
    assert os.path.isdir(f"{index}/v-not-ours")
    got = index_store.load(spark, index)["postings"]
    for name in sorted({r["f"] for r in got.select(F.input_file_name().alias("f")).distinct().collect()}):
        rows = [(r["term"], r["unit_id"]) for r in spark.read.parquet(name).collect()]
        assert rows == sorted(rows)


def test_limit_of_zero_and_bad_numbers(spark, repo):
    s = opened(spark, repo)
    assert s.reply('{"query":"charge card","limit":0}')["results"] == []
    assert len(s.reply('{"query":"charge card","limit":-3}')["results"]) == 0
    assert s.reply('{"query":"charge card","limit":1e400}')["results"]
    assert s.reply('{"action":"neighbors","id":"pay/charge.py:9:gateway_send","hops":0}')["neighbors"] == []
    zero = s.reply('{"action":"search","query":"refund invoice","graph":true,"hops":0,"limit":1}')
    assert [r["id"].split(":")[0] for r in zero["results"]] == ["pay/refund.py"]
