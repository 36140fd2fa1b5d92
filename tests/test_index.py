"""The stored index and stored vectors: changes write what changed alone and give what an index made anew gives."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.engine import Config, Engine
from palimpsest.operators import embed, search

WORDS = [f"w{i}" for i in range(40)] + ["common"] * 30


def texts(r, ids):
    return {i: " ".join(r.choices(WORDS, k=r.randint(0, 12))) for i in ids}


def frame(spark, nodes):
    return spark.createDataFrame([(f"n{i:03d}", t) for i, t in nodes.items()], "node_id string, text string")


def found(index, q):
    return sorted(map(tuple, search.bm25(index, q, 15).select("query_id", "node_id", "score", "rank").collect()))


def rows_of(spark, path, name):
    return spark.read.parquet(f"{path}/postings/segment={name}").count()


def test_changes_against_an_index_made_anew(spark, tmp_path):
    r, path = random.Random(6), f"file://{tmp_path}/index"
    q = spark.createDataFrame([(i, " ".join(r.choices(WORDS, k=3))) for i in range(12)], "query_id int, text string")
    index, nodes = search.StoredIndex(spark, path, most=3), texts(r, range(60))
    versions = []
    for step in range(7):
        if step:
            nodes = {i: t for i, t in nodes.items() if r.random() > 0.05} | texts(r, r.sample(range(60 + step * 5), 4))
        reader = index.sync(frame(spark, nodes))
        want = found(frame(spark, nodes), q)
        assert found(reader, q) == want and found(index.reader(), q) == want
        live = index.segments()
        assert len(live) <= 3 and sum(s["n"] for s in live) == len(nodes) == reader.totals.first().n
        versions.append((reader, want))
        if step:  # a reader of the version before keeps its files
            assert found(versions[-2][0], q) == versions[-2][1]
    folders = {x.name for x in (tmp_path / "index/postings").iterdir()}
    assert len(folders) <= 7


def test_a_change_writes_its_own_postings(spark, tmp_path):
    r, path = random.Random(2), f"file://{tmp_path}/index"
    nodes, index = texts(r, range(200)), search.StoredIndex(spark, f"file://{tmp_path}/index")
    index.sync(frame(spark, nodes))
    before = index.segments()
    stamp = {f: f.stat().st_mtime_ns for f in Path(tmp_path / "index/postings").rglob("*.parquet")}
    changed = nodes | {5: "fresh words of one", 6: "more of them"}
    index.sync(frame(spark, changed))
    after = index.segments()
    assert [s["name"] for s in after[:-1]] == [s["name"] for s in before] and after[-1]["n"] == after[-1]["gone"] == 2
    assert rows_of(spark, path, after[-1]["name"]) == 7
    assert all(f.stat().st_mtime_ns == t for f, t in stamp.items())
    index.sync(frame(spark, changed))
    assert index.segments() == after
    assert index.sync(frame(spark, {})).totals.first().n == 0 and found(index.reader(), spark.createDataFrame([(1, "common")], "query_id int, text string")) == []


def test_empty_index(spark, tmp_path):
    index = search.StoredIndex(spark, f"file://{tmp_path}/index")
    q = spark.createDataFrame([(1, "common")], "query_id int, text string")
    assert found(index.sync(frame(spark, {})), q) == []
    assert len(found(index.sync(frame(spark, {1: "common", 2: None})), q)) == 1


def counting(path):
    """An encoder that writes down what it encodes, by batch."""

    def encode(given):
        import os
        import uuid

        os.makedirs(path, exist_ok=True)
        with open(f"{path}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(str(len(t)) for t in given))
        return np.ones((len(given), 8), np.float32)

    return encode


def encoded(path):
    return [[int(x) for x in f.read_text().split()] for f in Path(path).glob("*")] if Path(path).exists() else []


def test_vectors_are_made_once(spark, tmp_path):
    tree = tmp_path / "tree"
    tree.mkdir()
    for k in range(4):
        (tree / f"m{k}.py").write_text(f"def alpha_{k}(x):\n    return beta_{k}(x)\n")
    engine = lambda log: Engine(spark, Config(dim=8), f"file://{tmp_path}/store", counting(f"{tmp_path}/{log}"))
    engine("first").index(str(tree))
    first = sum(map(len, encoded(f"{tmp_path}/first")))
    assert first >= 4
    again = engine("again")
    assert again.vectors.count() == again.nodes.count()
    again.index(str(tree))
    assert encoded(f"{tmp_path}/again") == []
    (tree / "m1.py").write_text("def gamma(x):\n    return x\n")
    once = engine("changed")
    once.index(str(tree))
    assert 1 <= sum(map(len, encoded(f"{tmp_path}/changed"))) < first
    assert once.vectors.count() == once.nodes.count() and once.vectors.where(F.col("vector").isNull()).count() == 0
    assert once.known.count() <= once.nodes.count()


def test_batches_are_even(spark, tmp_path):
    """Characters with padding are at most 1.2 times the characters; equal texts are encoded once."""
    r = random.Random(9)
    rows = [(f"n{i}", "x" * int(r.paretovariate(0.8) * 10 % 3000) + str(i % 900)) for i in range(6000)]
    df = spark.createDataFrame(rows, "node_id string, text string")
    made = embed.missing(df, None, counting(f"{tmp_path}/log"), batch=64)
    assert made.count() == len({t for _, t in rows})
    batches = encoded(f"{tmp_path}/log")
    assert sum(max(b) * len(b) for b in batches) <= 1.2 * sum(map(sum, batches))


@pytest.mark.parametrize("empty", [True, False])
def test_missing_of_known(spark, tmp_path, empty):
    df = spark.createDataFrame([("a", "one"), ("b", None), ("c", "")], "node_id string, text string")
    known = embed.missing(df.limit(0) if empty else df, None, embed.hashed(4))
    assert embed.missing(df, known, embed.hashed(4)).count() == (2 if empty else 0)
