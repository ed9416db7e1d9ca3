"""The registered searches over all edges meet each kind of edge, with its own decay."""

from siftwell.plans import registry

DIR = "/root/testdata/sf0.001"


def test_searches_reach_over_every_kind_of_edge(spark):
    queries, sql = registry.queries(), registry.oracle_sql()
    rows = [r for r in queries["graph_search"](spark, DIR).collect()]
    via = {(r["query_id"] // 100, r["unit_id"].split(":")[0]) for r in rows if r["via_graph"]}
    assert {(0, "customer"), (1, "customer"), (1, "part"), (2, "order")} <= via
    best = {q: max(r["score"] for r in rows if r["query_id"] == q) for q in {r["query_id"] for r in rows}}
    for what, decay in ((("1", "customer"), 0.7), (("1", "part"), 0.3), (("0", "customer"), 0.5)):
        got = [round(r["score"] / best[r["query_id"]], 3) for r in rows if (str(r["query_id"] // 100), r["unit_id"].split(":")[0]) == what and r["via_graph"]]
        assert decay in got
    for name in ("graph_search", "research"):
        assert "LIKE" not in sql[name]
    reached = {r["unit_id"].split(":")[0] for r in queries["research"](spark, DIR).collect() if r["stop_reason"] == "new_graph_evidence"}
    assert {"nation", "customer", "order", "part"} <= reached
