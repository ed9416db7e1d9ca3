"""Command line: python -m siftwell bootstrap | index | search | annotate | agent | config | describe."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell import config
from siftwell.operators import describe as W
from siftwell.operators import rebuild as B
from siftwell.sources import index_store, patch, tree
from siftwell.streaming.session import Session

SETTINGS_FILE = "siftwell.toml"


def spark_session() -> SparkSession:
    s = SparkSession.builder.appName("siftwell").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def _say(what, indent: int | None = None) -> None:
    print(json.dumps(what, ensure_ascii=False, indent=indent, default=list), flush=True)


def _settings(args) -> config.Config:
    return config.load(os.path.join(args.root, SETTINGS_FILE))


def _index(args) -> str:
    named = args.output if args.command in ("bootstrap", "index") else args.index
    return named or os.path.join(args.root, ".siftwell", "index")


def _open(args, spark: SparkSession) -> Session:
    cfg = _settings(args)
    return Session(spark, index_store.load(spark, _index(args)), args.root, cfg=cfg, index_root=_index(args))


def bootstrap(args, spark) -> int:
    cfg = _settings(args)
    report = B.refresh(spark, args.root, _index(args), cfg, args.full)
    units = index_store.load(spark, _index(args))["units"]
    files = tree.read_tree(spark, args.root, cfg).select("path", "content")
    out = W.bootstrap(units, W.read_store(spark, args.root), files, cfg, report, args.limit)
    if args.json:
        _say(out)
        return 0
    step = out["next"]
    print(f"{report['indexed_units']} units and {report['graph_edges']} edges; {out['described']} described, {out['superseded']} outgrown, {out['missing']} without a description")
    print(f"{out['already_documented']} declarations carry documentation\nnext: {step['action']}: {step['why']}")
    for line in step["how"]:
        print(f"  - {line}")
    return 0


def index(args, spark) -> int:
    _say(B.refresh(spark, args.root, _index(args), _settings(args), args.full))
    return 0


def search(args, spark) -> int:
    request = {"action": "search", "query": args.query, "graph": args.graph, "hops": args.hops} | {k: v for k in ("limit", "max_chars") if (v := getattr(args, k)) is not None}
    out = _open(args, spark).answer(request)
    if args.json:
        _say(out)
    else:
        print(out.get("context") or (out.get("diagnosis") or {}).get("hint") or out.get("error", ""))
    return 1 if "error" in out else 0


def annotate(args, spark) -> int:
    """Numbered descriptive comments beside the sources; refused for a stale index."""
    s = _open(args, spark)
    if s.reply('{"action":"stats"}')["stale"]:
        print("the index is stale: build it anew first", file=sys.stderr)
        return 1
    lines: DataFrame = s.index["units"].select("path", "serial", B.marked(F.col("description"), F.col("serial"), F.col("unit_id")).alias("line")).orderBy("path", "serial")
    with open(args.output or os.path.join(args.root, ".siftwell", "annotations.md"), "w", encoding="utf-8") as f:
        last = None
        for r in lines.toLocalIterator():  # streamed in order
            if r["path"] != last:
                f.write(f"{'' if last is None else chr(10)}## {r['path']}\n\n")
                last = r["path"]
            f.write(f"- {r['line']}\n")
    return 0


def agent(args, spark) -> int:
    s = _open(args, spark)
    for line in sys.stdin:
        if line.strip():
            _say(s.reply(line))
    return 0


def settings(args, spark) -> int:
    at = os.path.join(args.root, SETTINGS_FILE)
    if args.action == "path":
        print(at)
    elif args.action == "init":
        if os.path.exists(at) and not args.force:
            print(f"{at} is there already", file=sys.stderr)
            return 1
        with open(at, "w", encoding="utf-8") as f:
            f.write(config.template())
    elif args.action == "list":
        _say({"source": at if os.path.exists(at) else None, "build_fingerprint": _settings(args).build_fingerprint(), "settings": _settings(args).values}, 2)
    elif args.action == "get":
        _say(_settings(args)[args.name])
    else:
        import tomllib

        value = tomllib.loads(f"v = {args.value}")["v"]
        text = open(at, encoding="utf-8").read() if os.path.exists(at) else ""
        with open(at, "w", encoding="utf-8") as f:
            f.write(config.updated(text, args.name, value))
    return 0


def describe(args, spark) -> int:
    s = _open(args, spark)
    units, entries, cfg = s._live(), s.entries, s.cfg
    if args.action == "status":
        got = W.status(units, entries, cfg["describe.skip"])
        n = units.count()
        _say({"units": n} | got | {"coverage": round(got["described"] / n, 4) if n else 0.0, "path": os.path.join(args.root, W.STORE)}, 2)
    elif args.action == "export":
        out = json.dumps(W.batch(units, entries, cfg, args.limit if args.limit is not None else cfg["describe.batch"]), ensure_ascii=False, indent=2)
        if args.output:
            with open(args.output, "w", encoding="utf-8") as f:
                f.write(out + "\n")
        else:
            print(out)
    elif args.action == "import":
        with open(args.file, encoding="utf-8") as f:
            given = json.load(f)
        out = s.describe_put({"descriptions": given.get("descriptions", []) if isinstance(given, dict) else given})
        _say(out, 2)
        return 1 if out["rejected"] else 0
    else:
        files = tree.read_tree(spark, args.root, cfg).select("path", "content")
        plan = W.insertions(units, entries, files)
        rows = patch.render(plan, files.select("path", F.decode("content", F.lit("UTF-8")).alias("source"))).orderBy("path")
        out = open(args.output, "w", encoding="utf-8", newline="") if args.output else sys.stdout
        for r in rows.toLocalIterator():
            out.write(r["patch"])
        if args.output:
            out.close()
        print(json.dumps(W.promotion(units, entries, plan)), file=sys.stderr)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siftwell", description="Index source trees and search them with evidence.")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, run, *flags, root: bool = False):
        c = sub.add_parser(name)
        c.add_argument("root", nargs="?", default=".") if root else c.add_argument("--root", default=".")
        for names, given in flags:
            c.add_argument(*names.split(), **given)
        c.set_defaults(run=run)
        return c

    number, text, yes = {"type": int, "default": None}, {"default": None}, {"action": "store_true"}
    add("bootstrap", bootstrap, ("--output", text), ("--full", yes), ("--limit", number), ("--json", yes), root=True)
    add("index", index, ("--output", text), ("--full", yes), root=True)
    add("search", search, ("query", {}), ("--index", text), ("--limit", number), ("--max-chars", number), ("--json", yes), ("--graph", yes), ("--hops", {"type": int, "default": 1}))
    add("annotate", annotate, ("--index", text), ("--output", text))
    add("agent", agent, ("--index", text))
    add("config", settings, ("action", {"choices": ("list", "get", "set", "init", "path")}), ("name", {"nargs": "?"}), ("value", {"nargs": "?"}), ("--force", yes))
    add("describe", describe, ("action", {"choices": ("status", "export", "import", "promote")}), ("file", {"nargs": "?"}), ("--index", text), ("--limit", number), ("--output", text))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    args.root = os.path.abspath(args.root)
    if args.command == "config":
        return args.run(args, None)
    return args.run(args, spark or spark_session())


if __name__ == "__main__":
    sys.exit(main())
