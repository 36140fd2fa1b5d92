"""The registered queries of the training-data operators over a whole small table, against brute force and their contracts."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate, queries, sharding
from test_free import classes, slow_fingerprint
from test_native import capacity, measures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows(sf):
    return pq.read_table(f"{sf}/documents.parquet").to_pylist()


def collected(spark, sf, name):
    return queries.QUERIES[name](spark, sf).collect()


def test_op3(spark, sf, rows):
    fp = {r["doc_id"]: slow_fingerprint(r["text"] or "") for r in rows}
    want = classes(list(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in collected(spark, sf, "op3_simhash_components")} == {i: (f"{fp[i]:016x}", want[i]) for i in fp}


def test_op4(spark, sf):
    pages = {r["page_id"]: r for r in pq.read_table(f"{sf}/pages.parquet").to_pylist()}
    digest = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    got = collected(spark, sf, "op4_warc_derivatives")
    assert Counter(r.page_id for r in got) == dict.fromkeys(pages, 2)
    for r in got:
        assert r.source_payload_digest == digest(pages[r.page_id]["html"].encode()) and r.block_digest == digest(r.block.encode())
        assert r.target_uri == pages[r.page_id]["url"] and r.refers_to == r.source_id and f"WARC-Refers-To: {r.source_id}" in r.record
        if r.warc_type == "conversion":
            assert "track(0)" not in r.block and "<p" not in r.block and "ad 0" not in r.block
            words = re.sub(r"\s+", " ", re.sub(r"<[^>]*>", " ", re.sub(r"(?s)<(script|style)\b.*?</\1>|<!--.*?-->", " ", pages[r.page_id]["html"])))
            assert Counter(r.block.replace(" ", "").replace("\n", "")) == Counter(__import__("html").unescape(words).replace(" ", "").replace("\xa0", "")) or "\xa0" in r.block


def test_op5(spark, sf, rows):
    got = collected(spark, sf, "op5_minimax_shards")
    text = {r["doc_id"]: r["text"] or "" for r in rows}
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    load, slots, place = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw)) and 0 <= r.shard < 24
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        place[text[r.doc_id]].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(p) == 1 for p in place.values())
    keys = spark.createDataFrame([(i, t) for i, t in text.items()], "i long, text string").select("i", sharding.group_key(F.col("text")).alias("k")).collect()
    groups = Counter()
    for r in keys:
        groups[r.k] += len(text[r.i].encode()) + 8
    assert max(load.values()) == capacity([groups[k] for k in sorted(groups)], 24)


def test_op7(spark, sf, rows):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    tok = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    start, want = 0, {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want[r["doc_id"]] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in collected(spark, sf, "op7_parquet_token_ids")} == want


@pytest.mark.parametrize(("name", "modulus", "rest", "threshold"), [("op2_quality_qda", 4, 2, 0.7), ("op8_weak_toxicity", 5, 0, 0.5)])
def test_op2_and_op8(spark, sf, rows, name, modulus, rest, threshold):
    got = collected(spark, sf, name)
    assert sorted(r.doc_id for r in got) == sorted(r["doc_id"] for r in rows)
    by_text, text = defaultdict(set), {r["doc_id"]: r["text"] or "" for r in rows}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
        by_text[text[r.doc_id]].add(r.score)
    assert all(len(s) == 1 for s in by_text.values())


def test_op9(spark, sf, rows):
    got = {r.doc_id: r for r in collected(spark, sf, "op9_adaptive_rules")}
    m = {r["doc_id"]: measures(r["text"] or "") for r in rows}
    fails = {i: x[0] < 50 or 100 * x[4] > 50 * x[0] for i, x in m.items()}
    assert {i: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for i, r in got.items()} == {i: (*m[i], fails[i]) for i in m}
    ratio = {"word_len": lambda x: x[1] / x[0], "symbols": lambda x: (x[2] + 1) / x[0], "dup_lines": lambda x: (x[3] + 1) / x[0], "repeats": lambda x: (x[4] + 1) / x[0]}
    good = [r for r in rows if not fails[r["doc_id"]]]

    def at(q, part, f):
        v = sorted(f(m[r["doc_id"]]) for r in part)
        return v[max(0, -(-int(round(q * len(v) * 1e9)) // 10**9) - 1)]

    cut = {}
    for g in {(r["lang"], r["source"]) for r in good}:
        parts = [[r for r in good if (r["lang"], r["source"]) == g], [r for r in good if r["lang"] == g[0]], good]
        w = [len(p) / (len(p) + 30) for p in parts]
        for k, f in ratio.items():
            high = 0.75 if k in ("word_len", "symbols") else 0.98

            def drawn(q, i, f=f, parts=parts, w=w):
                return at(q, parts[i], f) if i == 2 else w[i] * at(q, parts[i], f) + (1 - w[i]) * drawn(q, i + 1)

            s = [drawn(high, i) - drawn(1 - high, i) for i in range(3)]
            spread = max(s[0], s[1] / 2, s[2] / 2, (0.05 if k == "word_len" else 0.5) * drawn(0.5, 1))
            cut[g, k] = (drawn(1 - high, 0) - 4 * spread if k == "word_len" else -1, drawn(high, 0) + 4 * spread)
    want = {r["doc_id"]: not fails[r["doc_id"]] and all(cut[(r["lang"], r["source"]), k][0] <= f(m[r["doc_id"]]) <= cut[(r["lang"], r["source"]), k][1] for k, f in ratio.items()) for r in rows}
    assert {i: r.kept for i, r in got.items()} == want


def test_op10(spark, sf, rows):
    items = pq.read_table(f"{sf}/benchmark.parquet").to_pylist()
    items = [(b["item_id"], decontaminate.word_hashes(b["text"] or "")) for b in items]
    want = set()
    for r in rows:
        d = decontaminate.word_hashes(r["text"] or "")
        held = set(d.tolist())
        for i, b in items:
            n = min(13, len(b))
            if len(b) < 5 or sum(x in held for x in b.tolist()) < n - n // 6:
                continue
            if any(decontaminate.best_window(d, b, s)[0] >= n - n // 6 for s in range(-len(b), len(d))):
                want.add((r["doc_id"], i))
    assert {(r.doc_id, r.item_id) for r in collected(spark, sf, "op10_spaced_seed_overlaps")} == want


def test_pipeline_mix_against_its_sql(spark, tmp_path):
    """The mixing stage takes each row as often as the operator's SQL says of the stage's input."""
    import corpus_pipeline

    duckdb = pytest.importorskip("duckdb")
    r = random.Random(12)
    text = lambda: " ".join(r.choice("abcdefgh") * r.randint(1, 5) for _ in range(r.choice([0, 3, 40, 400])))
    data = [(i, text() if i % 17 else None, "en", [None, "a", "b", "c"][i % 7 % 4], 0) for i in range(300)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(x.doc_id for x in dict(corpus_pipeline.STAGES)["mixing"](spark, docs, str(tmp_path)).select("doc_id").collect())
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for i, size, taken in c.execute(f"select doc_id, size, taken from ({queries.ORACLES['op1_pareto_mix']})").fetchall():
        assert got[i] * size == taken
