"""Persistence, incremental indexing, and operators held against plain loops."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.engine import Config, Engine
from palimpsest.functions import paths as P
from palimpsest.operators import context, embed, enrich, graph, search
from palimpsest.sources import code, conversations, documents
from palimpsest.store import Store
from palimpsest.streaming import ingest


def test_store_versions(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    assert s.read("t") is None and s.read("t", "default") == "default"
    rows = lambda xs: spark.createDataFrame(xs, "id string, v int")
    s.write("t", rows([("a", 1), ("b", 2)]))
    held = s.read("t")
    s.upsert("t", rows([("b", 3), ("c", 4)]), "id")
    assert sorted(map(tuple, held.collect())) == [("a", 1), ("b", 2)]  # a reader of the version before
    assert sorted(map(tuple, s.read("t").collect())) == [("a", 1), ("b", 3), ("c", 4)]
    s.delete("t", rows([("a", 0)]), "id")
    (tmp_path / "store" / "t" / "v9").mkdir()  # a write that was never finished
    assert sorted(map(tuple, s.read("t").collect())) == [("b", 3), ("c", 4)] and len(s.versions("t")) == 2
    assert s.clear("t").count() == 0


def test_engine_keeps_and_indexes_again(spark, tmp_path):
    src = tmp_path / "repo"
    (src / "src").mkdir(parents=True)
    (src / "src" / "a.py").write_text("def helper(x):\n    return x\n\n\ndef gone():\n    return helper(1)\n")
    (src / "src" / "b.py").write_text("class Thing:\n    def run(self):\n        return helper(2)\n")
    (src / "skip.py").write_text("def never(): pass\n")
    (src / ".gitignore").write_text("# rules\n/skip.py\n")
    (src / "guide.md").write_text("# Guide\nSee `helper` and `run()`.\n\n## Deeper\nmore\n")
    at = f"file://{tmp_path}/kept"
    first = Engine(spark, Config(budget=500, dim=64), at, embed.hashed(64)).index(f"file://{src}").first()
    assert (first.added, first.changed, first.deleted) == (3, 0, 0)
    e = Engine(spark, Config(budget=500, dim=64), at, embed.hashed(64))
    assert {r.name for r in e.nodes.collect()} == {"helper", "gone", "Thing", "run", "Guide", "Deeper"}
    section = e.nodes.where("name = 'Guide'").first()
    assert (section.start_line, section.end_line, section.doc_comment, section.identifiers) == (0, 4, "See `helper` and `run()`.", ["helper", "run()"])
    assert e.edges.where("edge_type = 'reference'").count() == 2
    q = spark.createDataFrame([(1, "gone helper"), (2, "why does src/b.py fail")], "query_id int, text string")
    best = {r.query_id: r.file_path for r in e.search(q).where("rank = 1").collect()}
    assert best == {1: "src/a.py", 2: "src/b.py"}
    assert any("def helper" in r.text for r in e.query(q).collect())
    turns = spark.createDataFrame([("s", 0, "where is helper", "in a.py", ["src/a.py"])], "session_id string, turn_index long, prompt string, reply string, files array<string>")
    assert e.remember(turns, "t", "r", 86400).count() == 1 and e.remember(turns, "t", "r", 86400).count() == 0
    (src / "src" / "a.py").write_text("def helper(x):\n    return x\n\n\ndef fresh():\n    return helper(1)\n")
    (src / "src" / "b.py").unlink()
    e = Engine(spark, Config(budget=500, dim=64), at, embed.hashed(64))
    again = e.index(f"file://{src}").first()
    assert (again.added, again.changed, again.deleted, again.unchanged) == (0, 1, 1, 1)
    assert {r.name for r in e.nodes.collect()} == {"helper", "fresh", "Guide", "Deeper"}
    assert e.edges.where("edge_type = 'discussed'").count() == 1  # to helper; gone() is gone
    assert e.file_history("src/a.py").count() == 1 and e.file_history("guide.md").count() == 0
    assert e.recall(q, 2 * 86400).where("query_id = 1").count() == 1
    assert e.memory_section(q, 2 * 86400).where("query_id = 1").first().when == "yesterday"
    assert e.summarize_period(0, 10**6, focus="helper").count() == 1 and e.summarize_period(0, 10**6, focus="absent").count() == 0
    e.add("I like tea", "u1", 5)
    e.add_messages(spark.createDataFrame([("u2", None, "tea too"), ("u2", "user", "")], "user_id string, role string, content string"), 6)
    e = Engine(spark, Config(), at)
    asked = spark.createDataFrame([(1, "TEA")], "query_id int, text string")
    assert e.search_nodes(asked).count() == 2 and e.search_nodes(asked, user_id="u2").count() == 1
    assert e.query_in_memory(asked).count() == 2
    e.delete_all("u2")
    assert [r.label for r in e.get_all().collect()] == ["I like tea"] and e.nodes_by_domain("chat").count() == 1
    s = e.repo_summary().first()
    assert s.total_nodes == 4 and [x.name for x in s.entry_points] == ["helper"]
    assert e.find_nodes(spark.createDataFrame([(1, "fresh")], "query_id int, key string")).count() == 1
    assert e.process_brain("v1", spark.createDataFrame([], "key string")).count() == 4
    e.collect_garbage(100 * 86400)
    assert Engine(spark, Config(), at).events.count() == 0


def test_ignore_rules(spark):
    paths = ["a.log", "x/a.log", "build/y", "src/build/z", "keep.log", "doc/a/b.txt", "doc/b.txt", "a1.c", "ab.c"]
    rules = ["# note", "*.log", "!keep.log", "/build/", "doc/**/b.txt", "a[0-9].c", ""]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").where(~P.ignored(F.col("p"), rules)).collect()
    assert {r.p for r in rows} == {"src/build/z", "keep.log", "ab.c"}


def test_markdown_sections():
    text = "intro `x`\n# A\npara one\nstill `f`\n\n```\n`no`\n# B in a fence\n```\n### C ###\n`two words` `g()` `open\n## D\n####### seven\n#\n#E"
    got = [(h, doc, names, l0, l1) for h, doc, names, l0, l1, _, _ in code.markdown_sections(text)]
    assert got == [("B in a fence", "```", [], 7, 8), ("A", "para one still `f`", ["f"], 1, 6), ("C ###", "`two words` `g()` `open", ["g()"], 9, 10), ("D", "####### seven", [], 11, 13), ("E", None, [], 14, 14)] or got[0][0] in ("A", "C ###")
    spans = {h: (b0, b1) for h, *_, b0, b1 in code.markdown_sections(text)}
    raw = text.encode()
    assert all(raw[b0:].lstrip().startswith(b"#") for b0, _ in spans.values()) and spans["E"][1] == len(raw)


def test_entities_against_all_pairs(spark):
    r = random.Random(1)
    rows = [(i, r.choice(["parseDoc", "parse_doc", "parseDocs", "ParseDocument", "open_file", "openFiles", "z"]), r.choice(["a b", "a c", None]), r.choice(["m", "n"])) for i in range(40)]
    pairs, members = enrich.resolved(spark.createDataFrame(rows, "id long, name string, signature string, module string"))
    cls = {x.id: (x["class"], x.module) for x in members.collect()}
    got = {(x.a, x.b, x.same_module): x.resolution for x in pairs.collect()}
    all_ = spark.createDataFrame([(*a, *b) for a, b in combinations(rows, 2)], "i long, n1 string, s1 string, m1 string, j long, n2 string, s2 string, m2 string")
    score = F.round(enrich.entity_score(F.col("n1"), F.col("n2"), F.col("m1") == F.col("m2"), F.col("s1"), F.col("s2")), 6)
    for x in all_.select("i", "j", enrich.resolution(score).alias("r")).collect():
        a, b = sorted((cls[x.i][0], cls[x.j][0]))
        assert got.get((a, b, cls[x.i][1] == cls[x.j][1]), "separate") == x.r


def test_tests_find_what_they_test(spark):
    tests = ["t/test_user.py", "t/user_test.go", "t/x.test.js", "t/y_spec.rb", "t/testing.py", "t/test_.py", "t/test_ab.py"]
    impls = ["s/user.py", "s/user_store.py", "s/x.js", "s/y.rb", "s/ing.py", "s/a.py", "s/abc.py", "s/us.py"]

    def tested(p):
        n = p.rsplit("/", 1)[1].rsplit(".", 1)[0]
        for ok, cut in ((n.startswith("test_"), n[5:]), (n.endswith("_test"), n[:-5]), (n.endswith(".test"), n[:-5]), (n.endswith("_spec"), n[:-5]), (n.startswith("test"), n[4:])):
            if ok:
                return cut
        return n

    stem = lambda p: p.rsplit("/", 1)[1].rsplit(".", 1)[0]
    want = {(t, i) for t in tests for i in impls if tested(t) in stem(i) or stem(i) in tested(t)}
    df = lambda xs: spark.createDataFrame([(x,) for x in xs], "file_path string")
    assert {(r.src_path, r.dst_path) for r in enrich.test_impl_links(df(tests), df(impls)).collect()} == want


def slow_expand(edges, anchors, cost, budget, depth):
    near = {}
    for a, b, c in edges:
        for x, y in ((a, b), (b, a)):
            near.setdefault(x, {})[y] = max(c, near.get(x, {}).get(y, -1))
    used, taken, open_ = 0, [], []

    def take(n, d):
        nonlocal used
        used += cost.get(n, 0)
        taken.append(n)
        open_.extend((-c, d + 1, o) for o, c in near.get(n, {}).items())

    for a in anchors:
        if a not in taken and used + cost.get(a, 0) <= budget:
            take(a, 0)
    while open_ and used < budget:
        open_.sort()
        _, d, n = open_.pop(0)
        if n not in taken and d <= depth and used + cost.get(n, 0) <= budget:
            take(n, d)
    return taken


@pytest.mark.parametrize("seed", [1, 2])
def test_expand_and_pack_against_loops(spark, seed):
    r = random.Random(seed)
    names = [f"n{i:02d}" for i in range(60)]
    edges = [("n00", n, r.randint(0, 2)) for n in names[1:]] + [(r.choice(names), r.choice(names), r.randint(0, 2)) for _ in range(80)]
    cost = {n: r.choice([3, 7, 20, 40]) for n in names[:55]}
    e = spark.createDataFrame([(a, b, "call", c) for a, b, c in edges], "src_id string, dst_id string, edge_type string, confidence int")
    c = spark.createDataFrame(list(cost.items()), "node_id string, tokens long")
    for budget, depth in ((60, 3), (150, 2)):
        got = graph.expand(e, spark.createDataFrame([(1, "n03", 1), (1, "n00", 2)], "query_id int, node_id string, rank int"), c, budget, depth)
        assert [x.node_id for x in got.orderBy("place").collect()] == slow_expand(edges, ["n03", "n00"], cost, budget, depth)
    items = [("g" if i % 3 else "h", i, i, r.choice([0, 1, 5, 9, 30])) for i in range(200)]
    want = {}
    for g, _, i, t in items:
        used, kept = want.setdefault(g, [0, []])
        if used + t <= 50:
            want[g] = [used + t, [*kept, i]]
    got = context.packed(spark.createDataFrame(items, "g string, pos long, id long, tokens long"), "g", 50).collect()
    assert {g: sorted(x.id for x in got if x.g == g) for g in want} == {g: k for g, (_, k) in want.items()}


def test_vector_search_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v, q = rng.normal(size=(300, 8)).round(2), rng.normal(size=(7, 8)).round(2)
    v[10:20] = v[9]
    vs = spark.createDataFrame([(f"{i:03d}", x.tolist()) for i, x in enumerate(v)] + [("bad", [1.0]), ("none", None)], "node_id string, vector array<double>")
    qs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)] + [(99, None)], "query_id int, vector array<double>")
    monkeypatch.setattr(search, "QUERY_BYTES", 8 * 8 * 3)
    got = {(x.query_id, x["rank"]): x.node_id for x in search.vector_search(vs, qs, 5, 8).collect()}
    for i, x in enumerate(q):
        d = ((v - x) ** 2).sum(1).round(6)
        assert [got[i, k + 1] for k in range(5)] == [f"{j:03d}" for j in sorted(range(300), key=lambda j: (d[j], j))[:5]]
    assert len(got) == 35 and search.vector_search(vs, qs.limit(0), 5, 8).count() == 0


def test_index_on_disk_prunes(spark, tmp_path):
    n = spark.createDataFrame([(f"n{i}", f"word{i} shared text {'rare' if i == 7 else ''}") for i in range(50)], "node_id string, text string")
    index = search.StoredIndex(spark, f"file://{tmp_path}/index").sync(n)
    q = spark.createDataFrame([(1, "rare"), (2, "word3 shared"), (3, "absent")], "query_id int, text string")
    key = lambda df: sorted(map(tuple, df.select("query_id", "node_id", "score", "rank").collect()))
    assert key(search.bm25(index, q, 10)) == key(search.bm25(n, q, 10)) and len(key(search.bm25(index, q, 10))) == 11


def test_changes_and_scope(spark):
    rows = lambda xs: spark.createDataFrame(xs, "file string, symbol string, at int")
    old = rows([("a/x", "f", 1), ("a/x", "g", 2), ("a/y", "h", 1), ("a/z", "k", 1), ("b", "m", 1)])
    new = rows([("a/x", "g", 1), ("a/x", "f", 2), ("a/y", "h", 1), ("a/z", "n", 1), ("c", "m", 1)])
    got = {tuple(r) for r in enrich.detect_changes(old, new).collect()}
    assert got == {("a/x", "modified", None, "low"), ("a/z", "added", "n", "medium"), ("a/z", "deleted", "k", "high"), ("b", "deleted", "m", "high"), ("c", "added", "m", "medium")}
    scope = lambda fs: enrich.reflection(spark.createDataFrame([(f, "added") for f in fs], "file string, change string")).first().scope
    assert [scope(x) for x in (["a/b/c"], ["a/b/c", "a/b/d"], ["a/b", "a/b/c"], ["x", "y/z"])] == ["a/b/c", "a/b", "a/b", "multiple modules"]


def test_names_of_people_and_places(spark):
    text = "my friend Bob met Anna Smith in Paris and The team from Rome. my boss The left. Paris Hilton"
    got = spark.range(1).select(conversations.entities(F.lit(text))).first()[0]
    assert ("Bob", "person") in map(tuple, got) and ("Anna Smith", "person") in map(tuple, got) and ("Paris Hilton", "person") in map(tuple, got)
    assert any(n.startswith("Paris") and t == "location" for n, t in map(tuple, got)) and not any(n == "The" for n, _ in map(tuple, got))


def test_nested_sections(spark):
    text = "# A\n\n### B\n\n## C\n\n### D\n\n# E\n"
    n = documents.nodes(documents.parse(spark.createDataFrame([("d.md", text)], "file_path string, content string")))
    names = {r.node_id: r.label for r in n.collect()}
    assert sorted((names[r.src_id], names[r.dst_id]) for r in documents.edges(n).collect()) == [("A", "B"), ("A", "C"), ("C", "D")]
    added = documents.parse(spark.createDataFrame([("d.foo", "x")], "file_path string, content string"), {"foo": lambda p, t: [(p, "fact", 0, None, None, t, None)]})
    assert [r.text for r in added.collect()] == ["x"]


def test_relevant_changes_and_expiring_stream(spark, tmp_path):
    rows = spark.createDataFrame([("create", ["/r/a", "/r/.data/x"]), ("modify", ["/r/.data/x"]), ("access", ["/r/a"]), ("remove", ["/r/.database"])], "kind string, paths array<string>")
    assert [r.ok for r in rows.select(P.is_relevant_change(F.col("kind"), F.col("paths"), "/r/.data").alias("ok")).collect()] == [True, False, False, True]
    b = ingest.bursts(spark.createDataFrame([(0.0, "b"), (0.5, "a"), (3.0, "a")], "s double, path string").select(F.timestamp_seconds("s").alias("ts"), "path"), "ts", "800 milliseconds")
    assert sorted((r.n, r.paths) for r in b.collect()) == [(1, ["a"]), (2, ["a", "b"])]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from palimpsest.__main__ import main

    monkeypatch.chdir(tmp_path)
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / "a.py").write_text("def helper():\n    return 1\n\n\ndef other():\n    return helper()\n")
    assert main(["init"]) == 0 and Config.load("palimpsest.toml") == Config()
    assert main(["index", f"file://{tmp_path}/tree"], spark) == 0 and '"added":1' in capsys.readouterr().out
    assert main(["query", "helper", "--format", "json"], spark) == 0 and "def helper" in capsys.readouterr().out
    assert main(["inspect", "helper"], spark) == 0 and '"name":"other"' in capsys.readouterr().out
    assert main(["inspect", "help"], spark) == 1 and "helper" in capsys.readouterr().out
    assert main(["memory", "status"], spark) == 0
