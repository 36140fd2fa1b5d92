"""SimHash, token ids, decontamination, classifiers and WARC against brute force on small tables."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate, quality_qda, sharding, simhash, token_ids, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, fp string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", "own") for i, t in rows], DOCS).repartition(3)


def prose(r, n):
    return " ".join("".join(r.choice(["th", "an", "er", "ing", "on", "es"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def slow_fingerprint(text):
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(items, linked):
    """Smallest member of each item's class."""
    root = {x: x for x in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(items, 2):
        if linked(a, b):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {x: find(x) for x in items}


def test_simhash_components(spark):
    r = random.Random(3)
    base = [prose(r, 120) for _ in range(15)]
    texts = [*base, *base[:5], None, "", "\n", "One", "one", "A b", "É é x"]
    texts += [t + " tail" for t in base] + [t.upper() for t in base[:3]] + [prose(r, 3) for _ in range(60)]
    out = simhash.near_duplicates(docs(spark, list(enumerate(texts)))).collect()
    fp = {i: slow_fingerprint(t or "") for i, t in enumerate(texts)}
    assert {x.doc_id: x.fp % 2**64 for x in out} == fp
    want = classes(list(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    assert {x.doc_id: x.component_id for x in out} == want
    kept = simhash.dedupe(docs(spark, list(enumerate(texts))))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(want.values()))
    assert simhash.near_duplicates(docs(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("distance", [2, 4])
def test_simhash_links_in_crowded_buckets(spark, distance):
    """More fingerprints than centers that share a key are linked without pairs, and just as they should."""
    r = random.Random(5)
    center = r.getrandbits(64)
    fps = {center}
    for _ in range(3):
        fps |= {f ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for f in list(fps) for _ in range(4)}
    fps |= {center ^ x for x in range(0, 4096, 5)}  # one key, distances of all sizes
    fps |= {center ^ (r.getrandbits(24) << 40) for _ in range(60)}
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    assert len(fps) > max(len(simhash.center_masks(m, distance)) for m in simhash.block_masks(distance))
    got = {x.node: x.root for x in simhash.components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), distance)).collect()}
    want = classes(fps, lambda a, b: ((a ^ b) % 2**64).bit_count() <= distance)
    assert {f: got.get(f, f) for f in fps} == want


def test_simhash_keys_are_not_broadcast(spark, monkeypatch):
    """A fingerprint has 35 keys at distance 4, which the planner's sizes leave out: the driver must not gather them."""
    plans, write = {}, simhash.stored

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(simhash, "stored", noted)
    flips = F.lit(sum(1 << i for i in (3, 20, 41, 62)))
    pairs = spark.range(50).select(F.xxhash64("id").alias("a"), F.xxhash64("id").bitwiseXOR(flips).alias("b"))
    fps = spark.range(2_000).select(F.xxhash64("id").alias("fp")).union(pairs.select("b"))
    got = {(x.a, x.b) for x in simhash.links(fps, 4).collect()}
    assert got == {(min(x), max(x)) for x in pairs.collect()}
    assert "Generate explode" in plans["simhash-met"] and "Broadcast" not in plans["simhash-met"]


def test_simhash_keys_are_lossless():
    """Whatever bits differ, some key holds none of them."""
    r = random.Random(2)
    for distance in (2, 4):
        masks = simhash.block_masks(distance)
        for _ in range(5000):
            bits = sum(1 << i for i in r.sample(range(64), distance))
            assert any(not m & bits for m in masks)


def test_simhash_long_text():
    text = prose(random.Random(4), 100_000)
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_repeated_and_null_ids(spark):
    out = simhash.dedupe(docs(spark, [(1, "a b c"), (1, "a b c"), (None, "x y z"), (2, "a b c")])).collect()
    assert sorted((x.doc_id or 0) for x in out) == [0, 1]


def test_dedupe_keeps_a_row_of_each_component(spark):
    r = random.Random(6)
    texts = [prose(r, 80) for _ in range(8)]
    rows = [(None, t) for t in texts[:4]] + [(7, t) for t in texts[4:]] + [(None, texts[0]), (7, texts[5]), (3, texts[6]), (None, texts[7])]
    assert len({slow_fingerprint(t) for t in texts}) == 8
    got = [(x.doc_id, x.text) for x in simhash.dedupe(docs(spark, rows)).collect()]
    want = [*[(None, t) for t in texts[:4]], (7, texts[4]), (7, texts[5]), (3, texts[6]), (7, texts[7])]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_decontamination_by_row(spark):
    r = random.Random(8)
    item, clean = prose(r, 30), [prose(r, 60) for _ in range(4)]
    rows = [(None, clean[0]), (None, f"{clean[1]} {item}"), (None, clean[1]), (5, clean[2]), (5, item), (6, clean[3])]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = [(x.doc_id, x.text) for x in decontaminate.decontaminate(docs(spark, rows), bench).collect()]
    assert sorted(got, key=str) == sorted([(i, t) for i, t in rows if item not in t], key=str)


tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
ODD = ["", "a <|endoftext|> b", "x<|endoftext|>", "ﬁne ɐb Ǆ ªº µ ß", "naïve Ünï élan", "it's'", "a-b", "a.b", "x2 2x", "³ x²", "a\u00a0b", "a\u00adb", "a\u0085b", "e\u0301 a", "a  b", " a", "a ", "a\n", "\na", "a\n\nb", "it's\nI'll don't", "x y z", "a \n b", "<|endoftext|> b<|endoftext|>", "tab\tx", "a\0b c", "日本 語\n12 34", "a\r\nb", "!! ??\n  x", "a. b.c, d... 'e' f's g' é! 1. x9?", "\x1c a", "á. b"]


def test_token_files(spark, tmp_path):
    r = random.Random(1)
    rows = [(i * 3 % 101, prose(r, r.randint(0, 60)).replace(" th", "\nTh")) for i in range(101)] + [(500 + i, t) for i, t in enumerate(ODD)] + [(999, None)]
    path = f"file://{tmp_path}/tokens"
    name = public.path("byte_bpe_50k.json")
    token_ids.write_tokens(docs(spark, rows), path, name)
    tok = tokenizers.Tokenizer.from_file(name)
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    assert {x.doc_id: x.ids for x in token_ids.read_tokens(spark, path).collect()} == ids
    start, want = 0, {}
    for i in sorted(ids):
        want[i] = (start, len(ids[i]), zlib.crc32(np.array(ids[i], "<u4").tobytes()))
        start += len(ids[i])
    assert {x.doc_id: (x.start, x.n_tokens, x.ids_crc32) for x in token_ids.digests(spark, path).collect()} == want
    plan = token_ids.read_tokens(spark, path).where("doc_id = 7").select("n_tokens")._jdf.queryExecution().toString()
    assert "ids" not in plan.split("ReadSchema")[-1].split("\n")[0] and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in plan


def test_token_cache_eviction(monkeypatch):
    monkeypatch.setattr(token_ids, "CACHE", 50)
    name = public.path("byte_bpe_50k.json")
    tok = tokenizers.Tokenizer.from_file(name)
    r = random.Random(2)
    tokenizers.__dict__.get("_palimpsest_encoders", {}).clear()
    encode, plain = token_ids.encoder(name), token_ids.encoder(name, plain_marks=True)
    for _ in range(5):
        texts = [prose(r, 40) + r.choice([".", "!?", ""]) for _ in range(10)] + ODD
        assert [np.frombuffer(x, "<i4").tolist() for x in encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    tok.encode_special_tokens = True
    assert [np.frombuffer(x, "<i4").tolist() for x in plain(ODD)] == [tok.encode(t, add_special_tokens=False).ids for t in ODD]
    tokenizers.__dict__["_palimpsest_encoders"].clear()


def test_token_words_of_a_batch(monkeypatch):
    """A batch asks for a word once, whatever signs follow it, and as a part of a larger array too."""
    import pyarrow as pa

    name = public.path("byte_bpe_50k.json")
    tok = tokenizers.Tokenizer.from_file(name)
    tokenizers.__dict__.get("_palimpsest_encoders", {}).clear()
    encode, made = token_ids.encoder(name), []
    one = token_ids.Pieces.made
    monkeypatch.setattr(token_ids.Pieces, "made", lambda self, w: made.append((self.before, w)) or one(self, w))
    texts = ["so word, word. word; élan!", "la word?! word\nword: word\nso, élan", "x word,word word)", "<|endoftext|> a", "", "a  b"] * 20
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    for kind in (pa.string(), pa.large_string()):
        for k, n in ((0, 120), (7, 50)):
            assert [np.frombuffer(x, "<i4").tolist() for x in encode(pa.array(texts, kind).slice(k, n))] == want[k : k + n]
    kept = tokenizers.__dict__["_palimpsest_encoders"][name, False][3]
    assert len(made) == len(set(made)) and {"word", "élan", "word,word"} <= set(kept) and not any(w.endswith(tuple(token_ids.SIGNS)) for w in kept)
    tokenizers.__dict__["_palimpsest_encoders"].clear()


def test_masks_are_lossless():
    """Whatever two of thirteen places differ, some mask fits between."""
    fits = [frozenset(i + o for i, c in enumerate(m) if c == "1") for m in decontaminate.MASKS[:2] for o in range(decontaminate.WINDOW - len(m) + 1)]
    assert all(any(not f & {a, b} for f in fits) for a, b in combinations(range(decontaminate.WINDOW), 2))


def test_parts_of_short_items_are_lossless():
    for n in range(decontaminate.LEAST, decontaminate.WINDOW):
        spans = [set(range(at, at + len(decontaminate.MASKS[m]))) for m, at in decontaminate.parts(n)]
        assert set().union(*spans) == set(range(n))
        assert all(any(not s & set(c) for s in spans) for c in combinations(range(n), n // 6))


def slow_overlap(text, item):
    d, b = decontaminate.word_hashes(text).tolist(), decontaminate.word_hashes(item).tolist()
    n = min(13, len(b))
    return any(6 * (n - sum(x == y for x, y in zip(d[i : i + n], b[j : j + n]))) <= n for i in range(len(d) - n + 1) for j in range(len(b) - n + 1))


def test_decontamination(spark):
    r = random.Random(7)
    items = [(i, prose(r, 30)) for i in range(12)] + [(50, "too short an item"), (51, None), *[(50 + n, prose(r, n)) for n in range(5, 13)], (70, None), (None, items_of := prose(r, 20)), (71, items_of), (71, items_of)]
    rows = [(i, prose(r, 200)) for i in range(60)] + [(60, None), (61, "")]
    for k in range(12):
        w = items[k][1].split()
        if k % 3:
            for j in r.sample(range(len(w)), 2):
                w[j] = "changed"
        w = w[4:22] if k % 4 == 0 else w
        rows.append((100 + k, f"{prose(r, 50)} {' '.join(w).upper()}, {prose(r, 50)}"))
    rows.append((200, " ".join(t for _, t in items if t)))
    for i, t in items:
        n = len((t or "").split())
        if 5 <= n < 13:  # whole, and with each choice of as many words changed as may be, and one more
            rows.append((201, f"{prose(r, 9)} {t} {prose(r, 9)}"))
            for k in (n // 6, n // 6 + 1):
                for c in combinations(range(n), k):
                    w = t.split()
                    for j in c:
                        w[j] = "changed"
                    rows.append((1000 + len(rows), f"{prose(r, 3)} {' '.join(w)} {prose(r, 3)}"))
    rows += [(300, f"{items_of} {prose(r, 8_000)}"), (300, "same id"), (None, f"{prose(r, 5)} {items_of}"), (None, prose(r, 5)), (301, items_of), (301, items_of), (302, f"{items_of} end")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    theirs = {c: F.lit("theirs") for c in ("near", "class", "seed", "item", "around", "__dc")}
    out = decontaminate.overlaps(docs(spark, rows).withColumns(theirs), bench.withColumns(theirs)).collect()
    got = {(x.doc_id, x.item_id) for x in out}
    assert len(got) == len(out)
    long_enough = [(b, y) for b, y in items if y and len(decontaminate.word_hashes(y)) >= decontaminate.LEAST]
    assert got == {(i, b) for i, t in rows for b, y in long_enough if slow_overlap(t or "", y)}
    d = docs(spark, rows).withColumns(theirs)
    left = decontaminate.decontaminate(d, bench)
    assert left.columns == d.columns
    assert sorted(((x.doc_id, x.text) for x in left.collect()), key=str) == sorted(((i, t) for i, t in rows if not any(slow_overlap(t or "", y) for _, y in long_enough)), key=str)
    assert decontaminate.overlaps(docs(spark, []).limit(0), bench).count() == 0
    assert decontaminate.overlaps(docs(spark, rows), bench.limit(0)).count() == 0


def labelled(spark, n=400):
    r = random.Random(11)
    rows = []
    for i in range(n):
        bad, toxic = i % 5 == 0, i % 7 == 0
        w = prose(r, r.randint(30, 120)).split()
        if bad:
            w = [x + r.choice(["###", "&&&", "$$$"]) for x in w]
        if toxic:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["vileword", "nastyword"]))
        rows.append((i, " ".join(w), int(not bad), int(toxic)))
    return docs(spark, [x[:2] for x in rows] + [(9000, None), (9001, "")]), spark.createDataFrame([(x[0], x[2], x[3]) for x in rows] + [(None, 1, 1), (9001, None, None)], "doc_id long, quality int, toxic int"), rows


def test_quality_scores_against_scipy_free_formula(spark):
    """Class sums, shrinkage and scores again in numpy, from the whole texts."""
    d, labels, rows = labelled(spark)
    long = "Some words here, and 1 more! " * 20_000
    every = [*rows, (9000, "", None, 0), (9001, "", None, 0), (9002, long, None, 0), (9002, long, None, 0)]
    f = quality_qda.featured(d.union(docs(spark, [(9002, long), (9002, long)])).withColumns({c: F.lit("theirs") for c in ("x", "y", "score")})).cache()
    assert f.count() == len(every)
    got = {x.doc_id: x.score for x in quality_qda.scored(f, quality_qda.fit(quality_qda.training(f, labels.withColumn("x", F.lit("theirs")), "quality", 4, 2))).collect()}
    train = [(quality_qda.statistics(t.encode()), q) for i, t, q, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    x, y = np.array([a for a, _ in train]), np.array([q for _, q in train])
    shift, scale = x.mean(0), np.sqrt(np.maximum(x.var(0), 1e-6))
    z = (x - shift) / scale
    covs = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum((y == k).mean() * covs[k] for k in (0, 1))
    logs = []
    for k in (0, 1):
        c = 0.85 * covs[k] + 0.15 * pooled
        c = 0.95 * c + 0.05 * (np.trace(c) / len(c) + 1e-6) * np.eye(len(c))
        at = (np.array([quality_qda.statistics(t.encode()) for _, t, *_ in every]) - shift) / scale - z[y == k].mean(0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", at, np.linalg.inv(c), at) - 0.5 * np.linalg.slogdet(c)[1])
    want = 1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) / 2 + np.log((y == 1).sum() / (y == 0).sum()), -50, 50)))
    assert all(abs(got[i] - w) < 1e-6 for (i, *_), w in zip(every, want))
    assert quality_qda.featured(d.limit(0)).count() == 0


def test_quality_classifier(spark):
    d, labels, rows = labelled(spark)
    f = quality_qda.featured(d).cache()
    model = quality_qda.fit(quality_qda.training(f, labels, "quality", 4, 2))
    got = {x.doc_id: x.score for x in quality_qda.scored(f, model).collect()}
    assert len(got) == len(rows) + 2 and all(0 <= s <= 1 for s in got.values())
    held = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 4 == 2]
    assert np.mean([(got[i] >= 0.7) == bool(q) for i, _, q, _ in held]) > 0.95
    x = np.array([quality_qda.statistics(t.encode()) for _, t, *_ in rows[:50]])
    z = (x - model.shift) / model.scale
    for m, inv, logdet in zip(model.means, model.factors, model.logdets):
        cov = np.linalg.inv(inv.T @ inv)
        assert np.allclose(np.linalg.slogdet(cov)[1], logdet)
        assert np.allclose((((z - m) @ inv.T) ** 2).sum(1), np.einsum("ij,jk,ik->i", z - m, np.linalg.inv(cov), z - m))
    one = quality_qda.fit(quality_qda.training(f, labels.where("quality = 1"), "quality", 4, 2))
    assert set(one.score(x)) == {1.0}
    assert set(quality_qda.fit(f.limit(0).selectExpr("x", "1 AS y")).score(x)) == {0.5}


def slow_model(votes, y, rounds=12):
    """The label model by loops over documents, not over groups of equal votes: rates by class, discounts, prior."""
    n, v = votes.shape
    model = None
    for turn in range(rounds + 1):
        p = model[3](votes) if model else None
        q = np.array([(y[i] if y[i] >= 0 else 0.0) if model is None else p[i] if y[i] < 0 else 0.5 * y[i] + 0.5 * p[i] for i in range(n)], float)
        w = np.array([1.0 if model or y[i] >= 0 else 0.0 for i in range(n)])
        n1, n0 = (w * q).sum(), (w * (1 - q)).sum()
        rates = np.array([[((w * (1 - q) * votes[:, j]).sum() + 0.2) / (n0 + 20), ((w * q * votes[:, j]).sum() + 0.5) / (n1 + 2)] for j in range(v)]).clip(1e-5, 1 - 1e-5)
        weights = np.ones(v)
        if model:
            left = votes - (q[:, None] * model[0][:, 1] + (1 - q[:, None]) * model[0][:, 0])
            cov = (left * w[:, None]).T @ left / w.sum()
            c = np.abs(cov / np.outer(np.sqrt(np.diag(cov)) + 1e-9, np.sqrt(np.diag(cov)) + 1e-9)) * (1 - np.eye(v))
            weights = 1 / (1 + np.where(c > 0.15, c, 0).sum(1))
        prior = np.clip(n1 / (n1 + n0), 1e-4, 1 - 1e-4)

        def posterior(x, rates=rates, weights=weights, prior=prior):
            like = [(weights * np.log(np.where(x > 0, rates[:, k], 1 - rates[:, k]))).sum(1) for k in (0, 1)]
            return 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + like[1] - like[0], -40, 40)))

        old, model = model, (rates, weights, prior, posterior)
        if turn and np.abs(np.log(rates / old[0])).max() < 0.01 and np.abs(weights - old[1]).max() < 0.01:
            break
    return model


def test_label_model_against_loops(spark):
    r = np.random.default_rng(1)
    truth = r.random(3000) < 0.3
    votes = (r.random((3000, 4)) < np.where(truth[:, None], [0.7, 0.4, 0.2, 0.0], [0.05, 0.1, 0.1, 0.0])).astype(float)
    votes = np.hstack([votes, votes[:, :1]])
    y = np.where(r.random(3000) < 0.4, truth.astype(int), -1)
    rows = [([int(j) for j in np.flatnonzero(x)], int(k < 0), int(k == 0), int(k == 1)) for x, k in zip(votes, y)]
    per = spark.createDataFrame(rows, "votes array<int>, n long, n0 long, n1 long").groupBy("votes").agg(F.sum("n").alias("n"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).cache()
    got, want = toxicity.label_model(toxicity.summed(per, 5), 5), slow_model(votes, y)
    assert np.allclose(got.rates, want[0], rtol=1e-6) and np.allclose(got.weights, want[1]) and np.isclose(got.prior, want[2])
    assert np.allclose(got.posterior(votes), want[3](votes))
    assert got.weights[0] < 0.6 < 0.8 < got.weights[1]


def test_toxicity(spark):
    d, labels, rows = labelled(spark)
    long = ("fine words " * 20_000) + "vileword nastyword vileword"
    d = d.union(docs(spark, [(9002, long), (9003, "fine words " * 20_000), (None, rows[0][1]), (0, rows[0][1])])).withColumns({c: F.lit("theirs") for c in ("at", "n", "y", "score", "votes", "doc")})
    own = labels.where(~toxicity.held_out(labels.doc_id)).withColumn("text", F.lit("theirs"))
    model, features = toxicity.fit(d, own)
    assert {" vileword ", " nastyword "} <= {t for ts in model.finder.voters for t in ts}
    out = toxicity.scored(features, model).collect()
    got = {x.doc_id: x.score for x in out}
    assert len(out) == len(rows) + 6 and len({x.score for x in out if x.doc_id in (0, None)}) == 1
    held = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 5 == 0]
    assert all((got[i] >= 0.5) == bool(t) for i, _, _, t in held)
    assert 0 <= got[9000] == got[9001] < 0.5 and got[9003] < 0.5
    # scores again, from the text, by sums over all of the model's weights
    for i, t, *_ in [*rows[:60], (9002, long), (9000, "")]:
        x = np.zeros(model.finder.width)
        low = " " + re.sub(r"[\W_]+", " ", t.lower()).strip() + " "
        for j, terms in enumerate(model.finder.voters):
            x[j] = max(sum(low.startswith(s, k) for k in range(len(low))) for s in terms)
        at, n = model.finder.features(t)
        x[len(model.finder.voters) :] = np.bincount(at, n, model.finder.width)[len(model.finder.voters) :]
        z = (np.log1p(x) - model.linear.shift) / model.linear.scale
        assert abs(got[i] - 1 / (1 + np.exp(-(z @ model.linear.weights[1:] + model.linear.weights[0])))) < 1e-5
    kept = toxicity.filter_toxic(d, labels)
    assert kept.columns == d.columns
    assert {x.doc_id for x in kept.collect()} == {i for i, s in got.items() if s < 0.5}
    none, features = toxicity.fit(d, labels.where("toxic = 0"))
    assert features is None and none.linear.constant == 0.0
    assert toxicity.fit(d.limit(0), labels)[0].linear.constant == 0.0
    assert toxicity.scored(toxicity.featured(d.limit(0).select("text", "doc_id"), model.finder, "doc_id"), model).count() == 0


def members(data):
    """The content of each gzip member of a file, opened by itself."""
    out = []
    while data:
        d = zlib.decompressobj(31)
        out.append(d.decompress(data) + d.flush())
        assert d.eof
        data = d.unused_data
    return out


def response(body, *headers):
    http = b"\r\n".join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", *headers]) + b"\r\n\r\n" + body
    return warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Target-URI", "u")], http)


def test_warc_codings():
    page = "<title>T</title><p>héllo</p><p>two</p>".encode()
    chunks = lambda b: b"".join(f"{len(b[i : i + 7]):x};x=y\r\n".encode() + b[i : i + 7] + b"\r\n" for i in range(0, len(b), 7)) + b"0\r\n\r\n"
    import gzip

    for made in (response(page), response(chunks(page), b"Transfer-Encoding: chunked"), response(gzip.compress(page), b"Content-Encoding: gzip"), response(zlib.compress(page), b"Content-Encoding: deflate"), response(chunks(gzip.compress(page)), b"Transfer-Encoding: chunked", b"Content-Encoding: gzip")):
        meta, text = warc.derive(made)
        assert text[-1] == "T\nhéllo\ntwo" and "title: T" in meta[-1]
    assert warc.derive(response(b"not chunks", b"Transfer-Encoding: chunked"))[1][-1] == "not chunks"
    assert warc.derive(response(b"not gzip", b"Content-Encoding: gzip"))[1][-1] == "not gzip"


def test_warc_records_between_pieces():
    """Records whose block holds what stands between records, or begins with it, come back whole; a record of 16 MB is a member too."""
    odd = [b"a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nb", b"WARC/ at once", b"", b"x" * (17 << 20), b"\r\n\r\nWARC/\r\n\r\nWARC/"]
    records = [warc.record([("WARC-Type", "response")], b) for b in odd]
    data = b"".join(r + b"\r\n\r\n" for r in records)
    assert list(warc.whole_records(iter(data.split(warc.BETWEEN)))) == records
    assert [m for m in members(b"".join(warc.member(r) + b"\0" for r in records)) if m] == [r + b"\r\n\r\n" for r in records]


def test_warc_pages_of_any_shape():
    import time

    began = time.time()
    for bad in ("<script" * 200_000, "<!--" * 200_000, "<a " * 300_000, "<a href=" * 200_000 + ">", "<title>" * 200_000, "<" * 500_000, "<p>word</p>" * 100_000):
        warc.plain_text(bad), warc.outlinks(bad), warc.title_of(bad)
    assert time.time() - began < 20
    assert warc.plain_text("a<script>x</script >b<STYLE>y</style>c<!-- z -->d<template>") == "a b c d"
    assert warc.outlinks('<a class="x" href=/b>1</a><area href="no"><a data-href="q">2</a><!-- <a href="c"> --><a\nhref=\'d\'>') == ["/b", "d"]


def test_warc_round_trip(spark, tmp_path):
    page = '<html><head><title>T &amp; t</title><script>var x="</p>";</script></head><body><h1>Head</h1><p>One <b>two</b>&nbsp;é<br>x &lt; y</p><!-- no --><a href="/a?b&amp;c">l</a></body></html>'
    pages = spark.createDataFrame([(1, "http://a/é", page), (2, None, None), (3, "http://b/", ""), (4, "u", "no tags at all"), (4, "u", "no tags at all")], "page_id long, url string, html string").withColumns({c: F.lit("theirs") for c in ("record", "block", "refers_to", "date")})
    made = warc.derivatives(warc.responses(pages)).collect()
    assert len(made) == 10
    first = {x.warc_type: x for x in made if x.page_id == 1}
    text = first["conversion"].block
    assert text == "T & t\nHead\nOne two é\nx < y\nl"
    assert "outlink: /a?b&c" in first["metadata"].block and "title: T & t" in first["metadata"].block and "source-header-content-type: text/html; charset=utf-8" in first["metadata"].block
    digest = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    assert first["conversion"].block_digest == digest(text.encode()) and first["conversion"].source_payload_digest == digest(page.encode())
    assert first["conversion"].concurrent_to == first["metadata"].record_id and first["conversion"].refers_to == first["metadata"].refers_to
    warc.write_warc(warc.derivatives(warc.responses(pages.repartition(2))), f"file://{tmp_path}/w")
    back = warc.read_warc(spark, f"file://{tmp_path}/w").collect()
    kinds = Counter()
    for x in back:
        head, fields, block = warc.split_headers(bytes(x.record))
        h = dict(fields)
        kinds[h["WARC-Type"]] += 1
        assert head == "WARC/1.1" and len(block) == int(h["Content-Length"]) and digest(block) == h["WARC-Block-Digest"]
        assert h["WARC-Type"] == "warcinfo" or h["WARC-Refers-To"].startswith("<urn:uuid:")
    files = list((tmp_path / "w").glob("*.warc.gz"))
    assert kinds == {"metadata": 5, "conversion": 5, "warcinfo": len(files)} and len(files) == len({x.path for x in back})
    for f in files:
        singles = members(f.read_bytes())
        assert all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") and m.count(b"WARC/1.1\r\n") == 1 for m in singles)
        assert b"WARC-Type: warcinfo" in singles[0] and len(singles) == sum(x.path.endswith(f.name) for x in back)
    assert warc.derive(b"WARC/1.1\r\nWARC-Type: request\r\n\r\nx") == []
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


def test_fingerprints_over_parts(monkeypatch):
    """Texts cut into words at any size have the fingerprints of whole ones."""
    r = random.Random(21)
    texts = ["", " ", "one", "one two", "One two three", *(" ".join(r.choice("abcdefg") * r.randint(1, 4) for _ in range(r.randint(0, 60))) + r.choice(["", "\n", " "]) for _ in range(80))]
    whole = [simhash.fingerprint(t.encode()) for t in texts]
    assert [x & (2**64 - 1) for x in whole] == [slow_fingerprint(t) for t in texts]
    parts = simhash.parts
    for size in (1, 3, 10):
        monkeypatch.setattr(simhash, "parts", lambda text, size=size: parts(text, size))
        assert [simhash.fingerprint(t.encode()) for t in texts] == whole


def test_clashing_names(spark, tmp_path):
    """Columns named like the operators' own, in any case, stay or are replaced."""
    passage = " ".join(f"word{k}" for k in range(20))
    docs = spark.createDataFrame([(1, passage, 5, 6, "x"), (2, "clean text of some words here", 7, 8, "y")], "doc_id long, text string, __dc_id long, __dc_key long, __dc_row string")
    bench = spark.createDataFrame([(9, passage)], "item_id long, text string")
    assert [tuple(x) for x in decontaminate.decontaminate(docs, bench).collect()] == [(2, "clean text of some words here", 7, 8, "y")]
    docs = spark.createDataFrame([(i, f"text {i}", -1, "s") for i in range(20)], "doc_id long, text string, Shard int, SLOT string")
    sharding.write_shards(docs, f"file://{tmp_path}/shards", 3)
    got = spark.read.parquet(f"file://{tmp_path}/shards")
    assert sorted(c.lower() for c in got.columns) == ["doc_id", "shard", "slot", "text"] and got.where("shard between 0 and 2").count() == 20
