"""What agent frameworks call, sync before a read, and sessions of shared logs."""

import json

import pytest

from palimpsest.adapters import ChatMemory, Retriever, as_json, tools
from palimpsest.engine import Engine
from palimpsest.sources import chatlogs


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    (root / "auth.py").write_text('def check_token(token):\n    """Checks a token."""\n    return load_session(token)\n\n\ndef load_session(token):\n    return token\n')
    e = Engine(spark)
    e.index(str(root))
    return e


def test_retriever(spark, engine):
    found = Retriever(engine, 2).invoke("check token")
    assert found[0].metadata["name"] == "check_token" and found[0].page_content.startswith("def check_token(token)\nChecks a token.\n") and len(found) <= 2
    assert json.loads(as_json(found))[0]["metadata"]["file_path"] == "auth.py"
    other = Engine(spark)
    other.add("I like green tea", "u1", 5)
    assert [d.page_content for d in Retriever(other).invoke("TEA")] == ["I like green tea"]


def test_tools(engine):
    t = tools(engine, lambda: 1000)
    assert t["search_code"].schema()["parameters"]["required"] == ["query"]
    assert "check_token" in t["get_context"](query="check token") and json.loads(t["search_code"](query="check token", limit=1))["name"] == "check_token"
    assert "load_session" in t["read_file_topology"](name="check_token")
    assert t["remember_turn"](content="tokens last an hour") == "1 remembered" and t["remember_turn"](content="tokens last an hour") == "0 remembered"
    assert "an hour" in t["recall_history"](query="how long do tokens last")
    with pytest.raises(TypeError):
        t["get_context"](text="x")


def test_chat_memory(spark):
    m = ChatMemory(Engine(spark), "u1")
    m.save_context("my dog is called Rex", "a good name", 7)
    assert m.load_memory_variables("dog") == {"history": "user: my dog is called Rex"}
    m.clear()
    assert m.load_memory_variables("dog") == {"history": ""}


def test_sync_before_a_read(spark, tmp_path):
    e, log = Engine(spark, path=f"file://{tmp_path}/store"), tmp_path / "logs" / "s.jsonl"
    log.parent.mkdir()
    line = lambda kind, text: json.dumps({"type": kind, "message": {"content": text}}) + "\n"
    log.write_text(line("human", "q") + line("assistant", "a"))
    sync = lambda now: e.sync_logs(f"{tmp_path}/logs", "r", now)
    assert sync(100).count() == 1 and sync(159) is None and e.events.count() == 1
    with log.open("a") as f:
        f.write(line("human", "q2") + line("assistant", "a2"))
    assert sync(150) is None
    assert sync(160).count() == 1 and e.events.count() == 2 and sync(230).count() == 0
    assert Engine(spark, path=f"file://{tmp_path}/store").events.count() == 2


def test_layers_and_layouts(spark):
    repo, j = "/work/repo", json.dumps
    bubble = lambda k, text, t=None, **more: j({"type": k, "text": text, "createdAt": t} | more)
    rows = [
        (1, "composerData:a", j({"createdAt": "100", "conversation": [json.loads(bubble(1, "q")), json.loads(bubble(2, "r", "150")), json.loads(bubble(2, "s"))], "root": "/work/repo/x"})),
        (2, "composerData:b", j({"createdAt": "200", "bubbleIds": ["y", "x"]})),
        (3, "bubbleId:b:x", bubble(2, "answer")),
        (4, "bubbleId:b:y", bubble(1, "see MARK", "250")),
        (5, "composerData:c", j({"createdAt": "300"})),
        (6, "bubbleId:c:1", bubble(1, "ask", context={"fileSelections": [{"path": "/work"}]})),
        (7, "bubbleId:c:2", bubble(2, "told")),
        (8, "composerData:d", j({"/work/repo": "only a key"})),
        (9, "bubbleId:d:1", bubble(1, "elsewhere", context={"fileSelections": [{"path": "/other", "uri": None}]})),
        (10, "bubbleId:lost:1", bubble(1, "MARK")),
        (11, "composerData:bad", "no json"),
    ]
    kv = spark.createDataFrame(rows, "rowid long, key string, value string")
    assert {(r.session_id, r.layer) for r in chatlogs.relevant_sessions(kv, repo, "MARK").collect()} == {("a", 1), ("b", 2), ("c", 3)}
    assert chatlogs.relevant_sessions(kv, "", "MARK").count() == 0
    got = {}
    for r in sorted(chatlogs.composer_messages(kv).collect(), key=lambda r: r.pos):
        got.setdefault(r.session_id, []).append((r.role, r.text, r.timestamp))
    assert got["a"] == [("user", "q", 100), ("assistant", "r", 150), ("assistant", "s", 150)]
    assert got["b"] == [("user", "see MARK", 250), ("assistant", "answer", 250)] and [x[1] for x in got["c"]] == ["ask", "told"]
