"""Streams with state: bursts over restarts and by the clock, logs by offsets, memory that takes each batch once."""

import json
import sqlite3
import time

from pyspark.sql import functions as F

from palimpsest.operators import memory
from palimpsest.sources import chatlogs
from palimpsest.store import Store
from palimpsest.streaming import ingest, stateful


def write(spark, rows, path):
    spark.createDataFrame([(u, f"1970-01-01 00:00:{s:06.3f}", p) for u, s, p in rows], "u int, t string, path string").select("u", F.to_timestamp("t").alias("ts"), "path").coalesce(1).write.mode("append").parquet(path)


def test_a_restart_in_a_burst(spark, tmp_path):
    """What stood in the checkpoint goes on: one row per burst, changes within the rest after one don't count."""
    src, out = f"file://{tmp_path}/src", f"file://{tmp_path}/out"

    def run():
        s = ingest.read_stream(spark, src, "u int, ts timestamp, path string")
        ingest.run_to_end(stateful.debounced(s, ["u"], 5000, rest=2000, late="1 second"), out, f"file://{tmp_path}/checkpoint")
        return sorted(tuple(r) for r in spark.read.parquet(out).collect())

    write(spark, [(1, 1.0, "b"), (1, 2.5, "a"), (2, 3.0, "x")], src)
    assert run() == []
    write(spark, [(1, 6.0, "b"), (2, 7.9, "x"), (1, 12.0, "late"), (1, 13.5, "c")], src)
    first = (1, 1000, 6000, 3, ["a", "b"])
    assert run() == [first]
    write(spark, [(3, 40.0, "z")], src)
    # 12.0 came one second after the burst had ended at 11.0, within the rest
    assert run() == [first, (1, 13500, 13500, 1, ["c"]), (2, 3000, 7900, 2, ["x"])]


def test_debounce_by_the_clock(spark, tmp_path):
    src, out = f"file://{tmp_path}/src", f"file://{tmp_path}/out"
    write(spark, [(1, 1.0, "b"), (1, 50.0, "a")], src)
    s = ingest.read_stream(spark, src, "u int, ts timestamp, path string")
    q = stateful.debounced(s, ["u"], 800).writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/c").trigger(processingTime="200 milliseconds").start(out)
    try:
        until = time.time() + 60
        while time.time() < until and not any((tmp_path / "out").glob("*.parquet")):
            time.sleep(0.3)
        time.sleep(2)  # the batch that wrote the row becomes whole
    finally:
        q.stop()
    assert [tuple(r) for r in spark.read.schema(f"u int, {stateful.BURST}").parquet(out).collect()] == [(1, 1000, 50000, 2, ["a", "b"])]


def test_key_value_rows_come_once(spark, tmp_path):
    spark.dataSource.register(chatlogs.KeyValueSource)
    db = sqlite3.connect(f"{tmp_path}/log.db")
    db.execute("create table cursorDiskKV (key text unique on conflict replace, value text)")
    put = lambda *rows: (db.executemany("insert into cursorDiskKV values (?, ?)", rows), db.commit())

    def run():
        s = spark.readStream.format("sqlite_kv").option("path", f"{tmp_path}/log.db").load()
        ingest.run_to_end(s, f"file://{tmp_path}/out", f"file://{tmp_path}/c")
        return sorted((r.key, r.value) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())

    put(("a", "1"), ("b", "1"))
    assert run() == [("a", "1"), ("b", "1")]
    put(("c", "1"), ("a", "2"))
    assert run() == [("a", "1"), ("a", "2"), ("b", "1"), ("c", "1")]
    assert len(run()) == 4
    assert spark.read.format("sqlite_kv").option("path", f"{tmp_path}/log.db").option("after", "2").load().count() == 2


def test_log_lines_by_turns(spark, tmp_path, monkeypatch):
    """Turns that end come once; a prompt that waits, or half a line, is read with the rest of its turn."""
    spark.dataSource.register(chatlogs.LogSource)
    log = tmp_path / "logs" / "p" / "s1.jsonl"
    log.parent.mkdir(parents=True)
    line = lambda kind, text: json.dumps({"type": kind, "message": {"content": text}}) + "\n"

    def run():
        s = spark.readStream.format("jsonl_log").option("path", f"{tmp_path}/logs").load()
        ingest.run_to_end(s, f"file://{tmp_path}/out", f"file://{tmp_path}/c")
        rows = spark.read.parquet(f"file://{tmp_path}/out")
        turns = memory.paired_turns(chatlogs.typed_messages(rows))
        return sorted((r.session_id, r.turn_index, r.prompt, r.reply) for r in turns.collect()), rows.count()

    with log.open("a") as f:
        f.write(line("human", "q1") + line("assistant", "é1") + line("human", "q2") + '{"type": "assist')
    assert run() == ([("s1", 0, "q1", "é1")], 2)
    assert run()[1] == 2
    with log.open("a") as f:
        f.write('ant", "message": {"content": "a2"}}\n' + line("human", "q3"))
    assert run() == ([("s1", 0, "q1", "é1"), ("s1", 1, "q2", "a2")], 4)
    other = tmp_path / "logs" / "s2.jsonl"
    other.write_text(line("human", "alone"))
    assert run()[1] == 4
    other.write_text(line("human", "alone") + line("assistant", "no more"))
    assert run()[0][-1] == ("s2", 0, "alone", "no more")


def test_log_ends_and_parts(tmp_path):
    """Ends are found from behind in blocks of any size, and parts read each line once."""
    import random

    r = random.Random(1)
    for k in range(60):
        lines = [r.choice(["assistant", "human", ""]) + "x" * r.randint(0, 12) for _ in range(r.randint(0, 8))]
        text = "\n".join(lines) + ("\n" if r.random() < 0.5 and lines else "")
        (tmp_path / f"{k}.jsonl").write_text(text)
        whole = text[: text.rfind("\n") + 1]
        at, want = 0, 0
        for x in whole.splitlines(keepends=True):
            at += len(x)
            want = at if "assistant" in x else want
        reader = chatlogs.LogLines({"path": str(tmp_path)})
        for block in (1, 2, 5, 1 << 16):
            reader.BLOCK = block
            assert reader._end(f"{tmp_path}/{k}.jsonl") == want, (text, block)
        reader.PART = r.randint(1, 9)
        file = f"{tmp_path}/{k}.jsonl"
        got = [v for p in reader.partitions({}, {file: want} if want else {}) for _, _, v in reader.read(p)]
        assert got == whole[:want].splitlines()


def test_batches_are_remembered_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    batch = lambda rows: spark.createDataFrame([(i, "r", h, c) for i, h, c in rows], "id string, repo_id string, content_hash string, content string")
    one = batch([("b", "h1", "x"), ("a", "h1", "x"), ("a", "h1", "x"), ("c", "h2", " "), ("d", "h3", "z")])
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(stateful.remembered(one, store, "events", "batch0")) == ["a", "d"]
    assert ids(stateful.remembered(one, store, "events", "batch0")) == ["a", "d"] and len(store.versions("events")) == 1
    two = batch([("e", "h1", "x"), ("f", "h4", "new")])
    assert ids(stateful.remembered(two, store, "events", "batch1")) == ["a", "d", "f"]
    assert store.last_key("events") == "batch1"
    # cut off before its version was whole, a batch comes again under its key
    assert ids(stateful.remembered(two, store, "events", "batch2")) == ["a", "d", "f"]


def test_a_table_in_parts_streams_whole(spark, sf, tmp_path):
    """Tables that are folders of files give the same as those of one file."""
    from palimpsest.plans import catalogue

    for name in ("documents", "labels", "events"):
        spark.read.parquet(f"{sf}/{name}.parquet").repartition(3).write.parquet(f"file://{tmp_path}/{name}.parquet")
    for name in ("q_memory_stream", "q_stream_ingest"):
        one, parts = (sorted(tuple(r) for r in catalogue.QUERIES[name](spark, d).collect()) for d in (sf, f"file://{tmp_path}"))
        assert one == parts and one


def test_a_keys_bursts_go_out_together():
    """However many bursts a key has, its state is told once and one frame comes out."""
    import pandas as pd

    said = []

    class State:
        def get(self):
            said.append("get")

        def update(self, value):
            said.append("update")

    class Handle:
        def getValueState(self, name, kind):  # noqa: N802
            return State()

        def registerTimer(self, at):  # noqa: N802
            said.append("timer")

    b = stateful.Bursts(["u"], 10)
    b.init(Handle())
    frames = list(b.handleInputRows((1,), iter([pd.DataFrame({"at": range(0, 2000, 20), "path": ["x"] * 100})]), None))
    assert [len(f) for f in frames] == [99] and said == ["get", "update", "timer"]
