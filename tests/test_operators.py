"""Joins, ranking, graph, memory and context on small tables."""

from pyspark.sql import functions as F

from palimpsest.operators import context, enrich, graph, memory, ranking, search


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_fusion_prefers_what_both_lists_have(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, node_id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id int, node_id string, rank int")
    assert [r.node_id for r in search.rrf([(a, 1.0), (b, 1.0)]).orderBy("rank").collect()] == ["y", "x", "z"]


def test_bm25_ranks_and_ignores_stop_words(spark):
    nodes = spark.createDataFrame([("a", "parser parses tokens"), ("b", "the is of"), ("c", "parser")], "node_id string, text string")
    q = spark.createDataFrame([(1, "the parser"), (2, "nothing matches this")], "query_id int, text string")
    assert rows(search.bm25(nodes, q, 10), "query_id", "rank", "node_id") == [(1, 1, "c"), (1, 2, "a")]


def test_vectors(spark):
    v = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [1.0, 0.0]), ("c", None), ("d", [1.0])], "node_id string, vector array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<float>")
    assert rows(search.vector_search(v, q, 2, 2), "rank", "node_id", "score") == [(1, "b", 1.0), (2, "a", 0.333333)]


def test_penalties(spark):
    r = spark.createDataFrame([(1, "a", "tests/test_a.py", 1.0), (1, "b", "src/b.py", 0.5), (1, "c", "x/fixtures/c.py", 1.0), (1, "d", "README.md", 9.0)], "query_id int, node_id string, file_path string, score double")
    nodes = r.select("node_id", "file_path")
    out = ranking.rank_pipeline(r.select("query_id", "node_id", "score", F.lit(1).alias("rank")), nodes)
    assert rows(out, "rank", "node_id", "score") == [(1, "b", 0.5), (2, "a", 0.15), (3, "c", 0.05)]


def test_literal_boost_injects(spark):
    nodes = spark.createDataFrame([("a", "parse_file", "def parse_file()", None, "parse_file x", "a.py"), ("b", "other", "other()", None, "calls parse_file", "b.py")], "node_id string, name string, signature string, doc_comment string, text string, file_path string")
    q = spark.createDataFrame([(1, "parse_file"), (2, "plain words")], "query_id int, text string")
    ranked = spark.createDataFrame([(1, "b", 0.1), (2, "b", 0.1)], "query_id int, node_id string, score double")
    assert rows(ranking.literal_boost(ranked, nodes, q), "query_id", "rank", "node_id", "score") == [(1, 1, "b", 0.135), (1, 2, "a", 0.06), (2, 1, "b", 0.1)]


def test_edges(spark):
    nodes = spark.createDataFrame([("C", "class", "f", "C", 0, 100_000, 0, []), ("m", "method", "f", "m", 10, 20_000, 1, []), ("i", "function", "f", "i", 15, 16, 2, []), ("g", "function", "h", "m", 0, 9, 3, []), ("D", "doc_section", "d", "D", 0, 5, 4, ["i()()", "m"])], "node_id string, kind string, file_path string, name string, start_byte long, end_byte long, pos int, identifiers array<string>")
    assert rows(graph.containment(nodes), "src_id", "dst_id") == [("C", "i"), ("C", "m")]
    refs = spark.createDataFrame([(1, "f", 15), (2, "f", 16), (3, "f", 100_000)], "ref_id int, file_path string, offset long")
    assert rows(graph.innermost(refs, nodes), "ref_id", "node_id") == [(1, "i"), (2, "m")]
    calls = spark.createDataFrame([("C", "f", "m"), ("i", "f", "i"), ("g", "h", "i")], "src_id string, src_file string, name string")
    assert rows(graph.call_edges(calls, nodes), "src_id", "dst_id", "confidence") == [("C", "g", 0), ("C", "m", 2), ("g", "i", 1)]
    assert rows(graph.doc_reference_edges(nodes), "src_id", "dst_id", "confidence") == [("D", "g", 0), ("D", "i", 1), ("D", "m", 0)]


def test_expand_respects_budget_and_confidence(spark):
    e = spark.createDataFrame([("a", "b", "call", 1), ("a", "c", "call", 2), ("c", "d", "call", 2), ("d", "e", "call", 2), ("e", "f", "call", 2)], "src_id string, dst_id string, edge_type string, confidence int")
    cost = spark.createDataFrame([(x, 10) for x in "abcdef"], "node_id string, tokens long")
    anchors = spark.createDataFrame([(1, "a", 1)], "query_id int, node_id string, rank int")
    got = lambda budget: [r.node_id for r in graph.expand(e, anchors, cost, budget).orderBy("place").collect()]
    assert got(100) == ["a", "c", "d", "e", "b"]
    assert got(25) == ["a", "c"]
    assert got(5) == []
    assert rows(graph.k_hop(e, spark.createDataFrame([(1, "a")], "query_id int, node string"), 2), "node", "depth") == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]


def test_pack_skips_and_goes_on(spark):
    items = spark.createDataFrame([("g", i, i, t) for i, t in enumerate([500, 600, 400, 200])], "g string, pos long, id long, tokens long")
    assert rows(context.packed(items, "g", 1000), "id", "used") == [(0, 500), (2, 900)]


def test_turns_and_events(spark):
    m = spark.createDataFrame([("s", 0, "system", "x"), ("s", 1, "user", "q1"), ("s", 2, "user", "q2"), ("s", 3, "assistant", "a1"), ("s", 4, "assistant", "a2"), ("s", 5, "user", "q3")], "session_id string, pos int, role string, text string")
    turns = memory.paired_turns(m)
    assert rows(turns, "turn_index", "prompt", "reply") == [(0, "q2", "a1"), (1, "", "a2")]
    ev = memory.events_from_turns(turns, "t", "r", 77)
    assert rows(ev, "turn_index", "content", "created_at") == [(0, "User: q2\nAssistant: a1", 77), (1, "Assistant: a2", 77)]
    assert memory.fresh(ev, ev).count() == 0 and memory.fresh(ev, ev.limit(0)).count() == 2
    assert memory.upsert(ev, ev).count() == 2


def test_garbage(spark):
    day = 86400
    e = spark.createDataFrame([("old", 0, False), ("pinned", 0, True), ("a", 40 * day, False), ("b", 41 * day, False)], "id string, created_at long, pinned boolean")
    assert rows(memory.collect_garbage(e, 50 * day, 30, 2), "id", "gone") == [("a", "over_limit"), ("b", None), ("old", "expired"), ("pinned", None)]


def test_entities(spark):
    s = lambda a, b: spark.range(1).select(enrich.jaro_winkler(F.lit(a), F.lit(b))).first()[0]
    assert s("abc", "abc") == 1 and s("", "x") == 0 and abs(s("martha", "marhta") - 0.9611) < 1e-4 and abs(s("abcd", "abxy") - 0.7333) < 1e-3
    out = enrich.co_occurrence(spark.createDataFrame([(i, x) for i in range(3) for x in ("p", "q")] + [(9, "p"), (9, "z")], "set_id int, item string"))
    assert rows(out, "a", "b", "n", "confidence") == [("p", "q", 3, "unknown")]


def test_overlaps(spark):
    b = spark.createDataFrame([(1, "f", 0, 9, 1, False), (1, "f", 2, 3, 2, False), (1, "f", 4, 5, 3, True), (1, "f", 0, 9, 4, False), (1, "g", 2, 3, 5, False)], "query_id int, file_path string, start_line int, end_line int, place int, is_anchor boolean")
    assert rows(context.without_overlaps(b), "place") == [(1,), (3,), (5,)]


def test_garbage_of_one_second(spark):
    """A bulk load of one second: the least ids go, numbers and strings, from ranges that end within and at their edges."""
    from palimpsest.operators import memory

    for kind, ids in [("long", list(range(0, 30_000, 3))), ("string", [f"{i * 7919 % 65536:04x}{i:04d}" for i in range(6000)])]:
        rows = spark.createDataFrame([(i, 1000, False) for i in ids] + [(ids[0] + (1 if kind == "long" else "x"), 2000, True)], f"id {kind}, created_at long, pinned boolean")
        for most in (1, 1366, len(ids) - 1, len(ids) + 5):
            gone = {r.id for r in memory.collect_garbage(rows, 3000, 30, most).where("gone = 'over_limit'").select("id").collect()}
            assert gone == set(sorted(ids)[: max(0, len(ids) + 1 - most)])


def test_edges_of_common_names(spark):
    """Every pair of a common name comes once, without all pairs being compared: also of targets with two names, of sources in two files, of rows that come again."""
    import random

    r = random.Random(2)
    refs = [(f"s{r.randint(0, 30)}", f"f{r.randint(0, 2)}", r.choice("abc")) for _ in range(120)] + [("t1", "f1", "a")]
    targets = [(f"t{i}", f"f{i % 3}", "abcd"[i % 4]) for i in range(40)] + [("t1", "f1", "a"), ("t1", "f2", "b"), ("t5", "f2", "b"), ("t9", "f0", "z"), ("s3", "f1", "c")]
    n = {x: sum(t[2] == x for t in targets) for x in "abcdz"}
    kind = lambda a, b, x: 2 if a == b else 1 if n[x] == 1 else 0
    want = {(s, t, kind(f, g, x)) for s, f, x in refs for t, g, y in targets if x == y and s != t}
    a, b = spark.createDataFrame(refs, "src_id string, src_file string, name string"), spark.createDataFrame(targets, "node_id string, file_path string, name string")
    calls, imports = graph.call_edges(a, b), graph.import_edges(a, b)
    assert rows(calls, "src_id", "dst_id", "confidence") == sorted(want)
    assert rows(imports, "src_id", "dst_id", "confidence") == sorted({(s, t, 0) for s, t, _ in want})
    for e in (calls, imports):
        assert e._jdf.queryExecution().optimizedPlan().nodeName() == "Union"
