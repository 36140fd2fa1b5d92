"""Budgeted expansion walks first without what takes no budget and opens no links, then over the links of taken nodes alone."""

import random

import pytest

from palimpsest.operators import graph

from test_engine import slow_expand


@pytest.mark.parametrize("depth", [1, 2, 3, 4])
def test_free_and_priced_nodes_against_loops(spark, depth):
    """Free nodes at any step, ties, and nodes that a surer but longer way takes first."""
    r = random.Random(depth)
    names = [f"n{i:02d}" for i in range(40)]
    edges = [(r.choice(names), r.choice(names), r.randint(0, 2)) for _ in range(90)]
    cost = {n: r.choice([0, 3, 7, 20]) for n in names[:25]}
    e = spark.createDataFrame([(a, b, "call", c) for a, b, c in edges], "src_id string, dst_id string, edge_type string, confidence int")
    asked = {q: r.sample(names, 2) for q in range(8)}
    anchors = spark.createDataFrame([(q, n, k) for q, ns in asked.items() for k, n in enumerate(ns, 1)], "query_id int, node_id string, rank int")
    got = graph.expand(e, anchors, spark.createDataFrame(list(cost.items()), "node_id string, tokens long"), 60, depth).orderBy("query_id", "place").collect()
    for q, ns in asked.items():
        assert [x.node_id for x in got if x.query_id == q] == slow_expand(edges, ns, cost, 60, depth)


def test_links_of_what_is_not_taken_stay_away(spark, monkeypatch):
    """Of 30 parts with 50 free ends each the budget takes 3: the other parts' ends meet no query."""
    rows, walk = {}, graph.kept

    def counted(df, name):
        out = walk(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(graph, "kept", counted)
    edges = [("a", f"p{i:02d}", "import", 1) for i in range(30)] + [(f"p{i:02d}", f"free{i}-{k}", "call", 0) for i in range(30) for k in range(50)]
    e = spark.createDataFrame(edges, "src_id string, dst_id string, edge_type string, confidence int")
    costs = spark.createDataFrame([(f"p{i:02d}", 10 + i) for i in range(30)], "node_id string, tokens long")
    anchors = spark.createDataFrame([(1, "a", 1)], "query_id int, node_id string, rank int")
    got = graph.expand(e, anchors, costs, 35, 2)
    assert sorted(x.node_id for x in got.where("depth = 1").collect()) == ["p00", "p01", "p02"]
    assert got.count() == 1 + 3 + 3 * 50
    assert rows["expand-first"] <= 2 * 30 and rows["expand-taken"] == 4
