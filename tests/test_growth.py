"""What a large table would break: exchanges of pairs, batches held whole, all rows of a group in one task."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import context, enrich, graph, literals, search
from palimpsest.plans import catalogue, tools
from palimpsest.sources import documents


@pytest.mark.parametrize("limits", [None, {"CELLS": 5, "ROWS": 3, "CLASSES": 4}])
def test_bm25_pairs_stay_with_their_nodes(spark, monkeypatch, limits):
    """No exchange of (query, node) pairs, queries of the same known terms scored once, ties by id; in blocks and parts, too."""
    import math
    import random

    for name, n in (limits or {}).items():
        monkeypatch.setattr(search, name, n)
    monkeypatch.setattr(search, "_best", lambda hit, rows, *a, f=search._best: seen.append(len(set(rows.column("class").to_pylist()))) or f(hit, rows, *a))
    r, seen = random.Random(3), []
    docs = {f"n{i:03d}": r.choices([f"w{k}" for k in range(9)] + ["common"] * 4, k=r.randint(0, 30)) for i in range(120)} | {f"same{i}": ["w1", "common"] for i in range(30)}
    asked = {i: r.sample([f"w{k}" for k in range(9)] + ["common"], 2) + [f"unknown{i}"] for i in range(25)} | {25: ["w1", "w2"], 26: ["w2", "w1"], 27: ["nothing"]}
    n = spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()], "node_id string, text string")
    found = search.bm25(n, spark.createDataFrame([(k, " ".join(v)) for k, v in asked.items()], "query_id int, text string"), 7)
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, node_id", found._jdf.queryExecution().toString())
    assert sum(seen) == len({frozenset(w for w in v if "unknown" not in w and w != "nothing") for v in asked.values()} - {frozenset()})
    mean, want = sum(map(len, docs.values())) / len(docs), []
    for q, terms in asked.items():
        scores = {}
        for t in terms:
            df = sum(t in v for v in docs.values())
            for k, v in docs.items():
                if t in v:
                    tf = v.count(t)
                    scores[k] = scores.get(k, 0) + math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(v) / mean))
        want += [(q, rank, k, s) for rank, (s, k) in enumerate(sorted((-round(s, 6), k) for k, s in scores.items())[:7], 1)]
    assert sorted((x.query_id, x["rank"], x.node_id, -x.score) for x in found.collect()) == sorted(want)


def test_parsers_hold_parts(spark, monkeypatch):
    """However many files and rows, a task makes Arrow batches of bounded rows; the rows are those of the files."""
    monkeypatch.setattr(documents, "PART_ROWS", 7)
    monkeypatch.setattr(documents, "PART_BYTES", 400)
    files = spark.createDataFrame([(f"f{i:02d}.html", f"<h1>H{i}</h1>" + "".join(f"<p>fact {i} {k}</p>" for k in range(i % 30))) for i in range(60)] + [("n.html", None), ("x.bin", "no")], "file_path string, content string").coalesce(1)
    units = documents.parse(files)

    assert units.count() == 60 + sum(i % 30 for i in range(60)) + 1
    batch = pa.RecordBatch.from_pydict({"p": [f"f{i}" for i in range(90)], "t": ["x" * 50] * 90})
    made = list(documents.parts([batch], lambda p, t: [(p, k) for k in range(9 if p == "f3" else 1)], pa.schema([("p", pa.string()), ("k", pa.int32())])))
    assert sum(b.num_rows for b in made) == 98 and max(b.num_rows for b in made) <= 7


def test_code_is_parsed_once(spark, tmp_path):
    """Nodes, references and all that is made of them come of one reading of each file."""
    log = str(tmp_path / "log")

    def seen(path):
        with open(log, "a") as f:
            f.write(f"{path}\n")
        return path

    files = spark.createDataFrame([(f"m{k}.js", f"function f{k}(a) {{\n  return f{k + 1}(a);\n}}\n") for k in range(20)], "file_path string, content string")
    files = files.select(F.udf(seen)("file_path").alias("file_path"), "content")
    assert tools.code_edges(files).count() == 19
    with open(log) as f:
        assert sorted(f.read().split()) == sorted(f"m{k}.js" for k in range(20))


def test_overlaps_without_pairs(spark):
    """Spans of one file aren't compared with each other: no join by file; equal spans, equal places and missing lines as before."""
    import random

    r = random.Random(8)
    rows = [(1, r.choice("ab"), r.choice([None, *range(6)]), r.choice([None, *range(4, 9)]), r.randint(0, 40), r.random() < 0.2) for _ in range(150)]
    b = spark.createDataFrame(rows, "query_id int, file_path string, start_line int, end_line int, place int, is_anchor boolean")
    holds = lambda y, x: None not in (*y[2:4], *x[2:4]) and y[1] == x[1] and y[2] <= x[2] and y[3] >= x[3] and (y[2:4] != x[2:4] or y[4] < x[4])
    gone = {x[4] for x in rows if not x[5] and any(holds(y, x) for y in rows)}
    found = context.without_overlaps(b)
    assert "file_path" not in "".join(x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x)
    assert sorted(map(str, found.select(*b.columns).collect())) == sorted(str(x) for x in b.collect() if x.place not in gone)


def test_walks_look_at_edges_where_they_are(spark):
    """Reach and expansion put no order on all edges: k_hop makes steps distinct, expand groups edges at reached nodes alone."""
    e = spark.createDataFrame([("a", "b", "call", 1), ("a", "b", "import", 2), ("b", "c", "call", 0), ("c", "d", "call", 0), ("x", "y", "call", 0)], "src_id string, dst_id string, edge_type string, confidence int")
    seeds = spark.createDataFrame([(1, "a")], "query_id int, node string")
    found = graph.k_hop(e, seeds, 2)
    assert "keys=[node" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(1, "a", 0), (1, "b", 1), (1, "c", 2)]
    costs = spark.createDataFrame([(n, 10) for n in "abcdxy"], "node_id string, tokens long")
    got = graph.expand(e, seeds.select("query_id", F.col("node").alias("node_id"), F.lit(1).alias("rank")), costs, 30, 3)
    assert "LeftSemi" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((x.node_id, x.place, x.depth, x.used) for x in got.collect()) == [("a", 1, 0, 10), ("b", 2, 1, 20), ("c", 3, 2, 30)]


def test_pairs_of_sets_by_parts(spark, monkeypatch):
    monkeypatch.setattr(enrich, "SET_ROWS", 10)
    x = spark.createDataFrame([(i // 3, i % 7) for i in range(300)], "set_id int, item int")
    found = enrich.co_occurrence(x, 2)
    assert "hashpartitioning(set_id" in (plan := found._jdf.queryExecution().executedPlan().toString()) and re.search(r"hashpartitioning\(set_id#\d+, 30\)", plan)
    assert found.agg(F.sum("n")).first()[0] == 300


def test_grams_leave_by_steps(monkeypatch):
    """A task holds the grams of a step of texts and not those of its batch."""
    monkeypatch.setattr(literals, "STEP", 5)
    batch = pa.RecordBatch.from_pydict({"key": list(range(40)), "text": [f"word {i:04d}".encode() for i in range(40)]})
    made = list(literals._counts([batch], [4], literals.np.ones(1 << literals.FILTER_BITS, bool)))
    assert len(made) == 8 and sum(sum(b.column(1).to_pylist()) for b in made) == 40 * 6


def test_queries_of_a_table_read_its_texts_once(spark, tmp_path, monkeypatch):
    """Without a stored index each text is read once and its other words stay where they are; with too many terms to send, an index gives the same."""
    log = str(tmp_path / "log")

    def seen(text):
        with open(log, "a") as f:
            f.write("x\n")
        return text

    docs = [(f"n{i:02d}", f"w{i % 7} w{i % 5} w{i % 5} other{i}, Common") for i in range(60)] + [("null", None), ("empty", ""), ("signs", " -- "), ("n03", "w1 twice")]
    n = spark.createDataFrame(docs, "node_id string, text string").coalesce(2)
    q = spark.createDataFrame([(1, "w1 w2"), (2, "common nothing"), (3, "w4"), (4, ""), (5, None)], "query_id int, text string")
    found = search.bm25(n.select("node_id", F.udf(seen)("text").alias("text")), q, 9).collect()
    with open(log) as f:
        assert len(f.readlines()) == len(docs)
    monkeypatch.setattr(search, "WORDS", 5)
    parts = search.bm25(n, q, 9).collect()
    monkeypatch.setattr(search, "CLASS_TERMS", 2)
    assert search.Scan.of(n, q.select(F.col("text").alias("term"))) is None
    assert sorted(found) == sorted(parts) == sorted(search.bm25(n, q, 9).collect()) and {x.query_id for x in found} == {1, 2, 3}
    assert search.bm25(n.limit(0), q, 9).count() == search.bm25(n, q.limit(0), 9).count() == 0


def test_ranking_makes_no_index(spark, sf, monkeypatch):
    """One batch of queries of the table itself doesn't write an index of all its words first."""
    monkeypatch.setattr(catalogue, "text_index", lambda *a: 1 / 0)
    assert catalogue.QUERIES["q_rank_pipeline"](spark, sf).count()


def most_written(plan):
    """Rows of the largest exchange of a plan that has run."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return most_written(plan.executedPlan())
    if "QueryStage" in plan.nodeName():
        return most_written(plan.plan())
    own, below = plan.metrics().get("shuffleRecordsWritten"), plan.children()
    return max([own.get().value() if own.isDefined() else 0, *(most_written(below.apply(i)) for i in range(below.size()))])


def test_common_names_are_dealt_as_grids(spark, monkeypatch):
    """Sources and targets of a common name go to the rows and columns of a grid, and not targets to every part of its pairs; the edges stay the same."""
    monkeypatch.setattr(graph, "PAIRS", 16)
    refs = [(f"s{i}", f"f{i % 3}", "a") for i in range(200)] + [(f"s{i}", "f9", "a") for i in range(0, 200, 9)] + [(f"s{i}", "f0", "b") for i in range(9)]
    targets = [(f"t{i}", f"f{i % 3}", "a") for i in range(200)] + [(f"t{i}", "f1", "b") for i in range(0, 90, 9)] + [("t1", "f1", "a"), ("s3", "f1", "a"), ("u", "f0", "c")]
    want = {(s, t, 2 if f == g else 0) for s, f, x in refs for t, g, y in targets if x == y and s != t}
    a, b = spark.createDataFrame(refs, "src_id string, src_file string, name string"), spark.createDataFrame(targets, "node_id string, file_path string, name string")
    for found, edges in ((graph.call_edges(a, b), want), (graph.import_edges(a, b), {(s, t, 0) for s, t, _ in want})):
        assert sorted((x.src_id, x.dst_id, x.confidence) for x in found.collect()) == sorted(edges)
    own = graph.import_edges(a, b.where("name = 'a'").dropDuplicates(["node_id"]))
    assert len(own.collect()) == 200 * 201 - 1 and most_written(own._jdf.queryExecution().executedPlan()) < 2000


def test_symbols_shuffle_no_line_items(spark, sf):
    """The parts that are used leave the tasks that read line items once each."""
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("q_import_edges", "q_call_edges"):
            found = catalogue.QUERIES[name](spark, sf)
            assert found.collect() and most_written(found._jdf.queryExecution().executedPlan()) < spark.read.parquet(f"{sf}/lineitem.parquet").count() / 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
