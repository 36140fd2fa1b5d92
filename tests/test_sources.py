"""Parsers, chat logs, streams and the engine."""

import json
import sqlite3

from pyspark.sql import functions as F

from palimpsest.engine import Config, Engine
from palimpsest.operators import memory
from palimpsest.sources import chatlogs, code, conversations, documents
from palimpsest.streaming import ingest

MD = "lost\n# A\npara one\nstill [name](http://u)\n\n## B\ntwo\n```\n# not a heading\n```\n# C\n"
RST = "Top\n===\n\ntext `here <http://x>`_ and\n\nSub\n---\nmore\n"
HTML = "<p>lost</p><h1>One</h1><p>a &amp; b</p><h2>Two</h2><p>c <a href=\"http://l\">link</a></p>"
PY = 'class A:\n    """Doc of A."""\n\n    def run(self, x):\n        return helper(x)\n\n\ndef helper(y):\n    return y\n'
RS = "/// Adds.\npub fn add(a: u8) -> u8 { twice(a) }\n\nfn twice(a: u8) -> u8 { a * 2 }\nstruct P { x: u8 }\n"


def files(spark, **texts):
    return spark.createDataFrame([(k.replace("__", "."), v) for k, v in texts.items()], "file_path string, content string")


def test_documents(spark):
    u = documents.parse(files(spark, a__md=MD, b__rst=RST, c__html=HTML, d__txt="one\n\ntwo\nlines", e__py="x = 1", f__md="")).collect()
    of = lambda path, unit: [r.text for r in sorted(u, key=lambda r: r["at"]) if r.file_path == path and r.unit == unit]
    assert of("a.md", "section") == ["A", "B", "C"] and of("a.md", "citation") == ["name"] and "lost" not in " ".join(of("a.md", "fact"))
    assert of("b.rst", "section") == ["Top", "Sub"] and [r.url for r in u if r.file_path == "b.rst" and r.unit == "citation"] == ["http://x"]
    assert of("c.html", "section") == ["One", "Two"] and of("c.html", "fact") == ["a & b", "c link"]
    assert of("d.txt", "fact") == ["one", "two\nlines"] and not [r for r in u if r.file_path == "e.py"]
    nodes = documents.nodes(documents.parse(files(spark, a__md=MD)))
    names = {r.node_id: r.label for r in nodes.collect()}
    pairs = {(names[r.src_id], names[r.dst_id], r.edge_type) for r in documents.edges(nodes).collect()}
    assert ("A", "B", "contain") in pairs and not any(a == "B" and b == "C" for a, b, _ in pairs)


def test_code(spark):
    n = code.extract_nodes(files(spark, a__py=PY, b__rs=RS, c__json="{}")).collect()
    assert {(r.kind, r.name) for r in n} == {("class", "A"), ("method", "run"), ("function", "helper"), ("function", "add"), ("function", "twice"), ("struct", "P")}
    by = {r.name: r for r in n}
    assert by["A"].doc_comment == "Doc of A." and by["run"].signature == "def run(self, x)" and by["add"].doc_comment == "Adds."
    refs = {(r.file_path, r.name, r.kind) for r in code.extract_references(files(spark, a__py=PY, b__rs=RS)).collect()}
    assert {("a.py", "helper", "call"), ("b.rs", "twice", "call")} <= refs


def test_conversation_graph(spark):
    doc = {"sessions": [{"id": "s1", "timestamp": "2024-01-01", "messages": [{"role": "user", "content": "I love green tea. I moved to Paris! my friend Anna Smith is here."}, {"role": "assistant", "content": "I like it"}]}, {"id": "s2", "messages": [{"role": "user", "content": "Let's use Spark."}]}]}
    nodes, edges = conversations.graph(conversations.sessions(files(spark, c__json=json.dumps(doc))))
    kinds = {}
    for r in nodes.collect():
        kinds.setdefault(r.kind, set()).add(r.label)
    assert kinds["topic"] == {"s1", "s2"} and kinds["preference"] == {"positive: green tea"} and kinds["decision"] == {"Spark"}
    assert "Paris" in kinds["location"] and "Anna Smith" in kinds["person"]
    assert edges.where("edge_type = 'followed_by'").count() == 1


def test_chat_logs(spark, tmp_path):
    a = [{"type": "human", "message": {"content": "hi"}, "timestamp": "2024-01-01T00:00:00Z"}, {"type": "assistant", "message": {"content": [{"type": "text", "text": "yo"}, {"type": "tool_use", "name": "Read", "input": {"file_path": "/r/a.py"}}]}, "timestamp": "1704067201000"}]
    (tmp_path / "one.jsonl").write_text("\n".join(map(json.dumps, a)) + "\nnot json\n")
    m = chatlogs.typed_messages(chatlogs.lines(spark, f"file://{tmp_path}/one.jsonl"))
    turns = memory.paired_turns(m).collect()
    assert [(t.prompt, t.reply) for t in turns] == [("hi", "yo")]
    r = m.where("role = 'assistant'").first()
    assert r.tools == ["Read"] and r.files == ["/r/a.py"] and r.timestamp == 1704067201
    b = [{"type": "session_meta", "cwd": "/x/repo", "session_id": "S"}, {"type": "response_item", "role": "user", "text": "q"}, {"type": "response_item", "role": "assistant", "content": "a", "tool_calls": [{"name": "sh"}]}, {"type": "session_meta", "cwd": "/other", "session_id": "T"}, {"type": "response_item", "role": "user", "text": "z"}]
    (tmp_path / "two.jsonl").write_text("\n".join(map(json.dumps, b)))
    s = chatlogs.session_messages(chatlogs.lines(spark, f"file://{tmp_path}/two.jsonl"), "repo").collect()
    assert [(x.session_id, x.role, x.text) for x in s] == [("S", "user", "q"), ("S", "assistant", "a")]


def test_key_value_store(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "kv.db")
    db.execute("create table cursorDiskKV (key text, value)")
    db.execute("insert into cursorDiskKV values (?, ?)", ("composerData:A", json.dumps({"createdAt": "1704067200000", "conversation": [{"type": 1, "text": "q"}, {"type": 2, "text": "a"}]})))
    for i, (t, x) in enumerate([(1, "q2"), (2, "a2")]):
        db.execute("insert into cursorDiskKV values (?, ?)", (f"bubbleId:B:{i}", json.dumps({"type": t, "text": x})))
    db.commit()
    db.close()
    spark.dataSource.register(chatlogs.KeyValueSource)
    kv = spark.read.format("sqlite_kv").option("path", str(tmp_path / "kv.db")).load()
    assert sorted((r.session_id, r.role, r.text) for r in chatlogs.composer_messages(kv).collect()) == [("A", "assistant", "a"), ("A", "user", "q"), ("B", "assistant", "a2"), ("B", "user", "q2")]
    assert spark.read.format("sqlite_kv").option("path", str(tmp_path / "kv.db")).option("after", "1").load().count() == 2


def test_streams(spark, tmp_path):
    e = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id int, h string")
    e.write.parquet(f"{tmp_path}/in")
    run = lambda: ingest.run_to_end(ingest.deduplicated(ingest.read_stream(spark, f"{tmp_path}/in", e.schema), "h"), f"{tmp_path}/out", f"{tmp_path}/cp")
    run()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    spark.createDataFrame([(9, "a"), (9, "c")], "id int, h string").write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert sorted(r.h for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b", "c"]
    d = ingest.manifest_diff(spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, file_hash string"), spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, file_hash string"))
    assert {r.path: r.outcome for r in d.collect()} == {"a": "unchanged", "b": "changed", "c": "deleted", "d": "added"}
    ch = spark.createDataFrame([("2024-01-01 00:00:00", "x"), ("2024-01-01 00:00:00.5", "y"), ("2024-01-01 00:00:09", "x")], "ts string, path string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r.n for r in ingest.bursts(ch, "ts", "800 milliseconds").collect()) == [1, 2]


def test_engine(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text(PY)
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "b.py").write_text(PY)
    (tmp_path / "guide.md").write_text("# Guide\nuse `helper` here\n")
    e = Engine(spark, Config(budget=500))
    e.index(f"file://{tmp_path}")
    q = spark.createDataFrame([(1, "helper function")], "query_id int, text string")
    assert e.search(q).orderBy("rank").first().file_path == "src/a.py"
    b = e.query(q).collect()
    assert any("def helper" in r.text for r in b)
    assert e.repo_summary().first().languages[0].files == 1
    turns = spark.createDataFrame([("s", 0, "where is helper", "in a.py")], "session_id string, turn_index long, prompt string, reply string")
    assert e.remember(turns, "t", "r", 100).count() == 1
    assert e.remember(turns, "t", "r", 100).count() == 0
    assert e.recall(spark.createDataFrame([(1, "helper")], "query_id int, text string"), 200).count() == 1
    assert Config.load("/nowhere").anchors == 5


def test_ignore_files_of_folders(spark, tmp_path):
    """Deeper rules over those above, later ones over earlier ones; ! doesn't reach below a folder that is left out; excludes count most."""
    made = {
        ".gitignore": "*.log\n/only_root.py\nout/\ngen/**/tmp\n# no rule\n\\#odd.py\n!main.log\n",
        ".git/info/exclude": "local.py\nkept.py\n",
        "sub/.gitignore": "!b.log\nc.py\ndeep/*.txt\n!kept.py\n",
        "sub/deep/.ignore": "!d.txt\n",
        "out/.gitignore": "!a.py\n",
    }
    rows = {"a.py": 1, "x.log": 0, "main.log": 1, "only_root.py": 0, "sub/only_root.py": 1, "out/a.py": 0, "sub/out/b.py": 0, "sub/out.py": 1, "gen/1/2/tmp": 0, "gen/tmp/x.py": 0, "#odd.py": 0, "local.py": 0, "sub/local.py": 0, "kept.py": 0, "sub/kept.py": 1,
            "sub/a.log": 0, "sub/b.log": 1, "sub/c.py": 0, "c.py": 1, "sub/deep/c.py": 0, "sub/deep/d.txt": 1, "sub/deep/e.txt": 0, "sub/deep/f/e.txt": 1, "sub/mine/z.py": 0}
    for path, text in (made | dict.fromkeys(rows, "x")).items():
        at = tmp_path / "tree" / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    got = {r.file_path for r in code.read_files(spark, f"file://{tmp_path}/tree", ["mine/"]).collect()}
    assert got == {p for p, kept in rows.items() if kept}
    got = {r.file_path for r in code.read_files(spark, f"file://{tmp_path}/tree", ["*.log"]).collect()}
    assert "main.log" not in got and "sub/b.log" not in got and "sub/mine/z.py" in got
