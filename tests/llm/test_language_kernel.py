"""Language identification: the kernel and regression by their formulas, held-out accuracy, defined cases."""

import random
import zlib

import numpy as np
import pyarrow.parquet as pq

from palimpsest.llm import language_kernel as lk

WORDS = {"en": "the of and thing that with", "de": "der die und nicht über straße", "fr": "le la été où naïf ça"}


def corpus(n, seed=1):
    r = random.Random(seed)
    return [(i, " ".join(r.choices(WORDS[lang].split(), k=r.randint(3, 30))), lang) for i in range(n) for lang in [r.choice(list(WORDS))]]


def slow_grams(text):
    words = "".join(c if ord(c) > 127 or c.isalpha() else " " for c in text.lower()).encode().split()
    s = b" " + b" ".join(words) + b" "
    return {s[i : i + n] for n in range(1, lk.LONGEST + 1) for i in range(len(s) - n + 1)} if words else set()


def test_grams(monkeypatch):
    for text in ["", "a", "Ab, c!", "Été 12 où", "日本語", " \n"] + [t for _, t, _ in corpus(30)]:
        assert lk.grams(text.encode()).tolist() == sorted(int.from_bytes(g, "big") for g in slow_grams(text))
    texts = ["où été a b c " * 9 + "\n\t 12 34 " + "x yz", "日" * 9, " 1 2 3 a"]
    whole = [lk.grams(t.encode()).tolist() for t in texts]
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(lk, "PART", size)
        assert [lk.grams(t.encode()).tolist() for t in texts] == whole


def test_model_is_kernel_ridge_regression(spark):
    """The collapsed model's values are those of regressions on explicit Nyström features, by sets and loops."""
    rows = corpus(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lk.fit(docs, sample=10_000, landmarks=9)
    names, part = lk.sampled(docs, 10_000)
    assert names == sorted(WORDS) and part.count() == 60
    by_lang = {}
    for r in sorted(part.collect(), key=lambda r: (r.lang, r.key)):
        by_lang.setdefault(r.lang, []).append((r.key, r.grams))
    marks = [set(g) for lang in names for _, g in by_lang[lang][:3]]
    universe = {g for m in marks for g in m if sum(g in x for x in marks) > 1}
    assert universe == set(model.universe.tolist())
    of = lambda x, y: len(x & y & universe) / np.sqrt(len(x & universe) * len(y & universe))
    values, vectors = np.linalg.eigh(np.array([[of(x, y) for y in marks] for x in marks]))
    kept = values > 1e-6 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])
    feature = lambda x: np.append(np.array([of(x, m) for m in marks]) @ root, 1.0)
    texts = [(set(g), lang) for lang in names for _, g in by_lang[lang]]
    x, y = np.array([feature(t) for t, _ in texts]), np.array([[1.0 if lang == n else -1.0 for n in names] for _, lang in texts])
    shrink = lk.RIDGE * np.eye(x.shape[1])
    shrink[-1, -1] = 1e-9
    solved = np.linalg.solve(x.T @ x + shrink, x.T @ y)
    some = [t for _, t, _ in corpus(20, 2)]
    want = np.array([feature(set(lk.grams(t.encode()).tolist())) @ solved for t in some])
    assert np.abs(model.values([lk.grams(t.encode()) for t in some]) - want).max() < 1e-3


def test_defined_cases(spark):
    rows = [(i, t, lang, 0) for i, t, lang in corpus(90)] + [(None, None, "en", 0), (1000, "", None, 0), (1001, "42 !?", "de", 0), (1002, "the of the", None, 0), (1002, "the of the", None, 0), (None, "der und", "de", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = lk.predict(docs, lk.fit(docs)).collect()
    assert [r.doc_id for r in got] == [r[0] for r in rows] and all(0 <= r.score <= 1 for r in got)
    assert [r.lang_pred for r in got[90:]] == ["und", "und", "und", "en", "en", "de"] and [r.score for r in got[90:93]] == [0, 0, 0]
    assert sum(r.lang_pred == x[2] for r, x in zip(got[:90], rows, strict=False)) >= 88
    empty = docs.limit(0)
    model = lk.fit(empty)
    assert lk.predict(empty, model).count() == 0 and {r.lang_pred for r in lk.predict(docs, model).collect()} == {"und"}
    one = lk.fit(docs.where("lang = 'fr'"))
    assert {r.lang_pred for r in lk.predict(docs.where("doc_id < 90"), one).collect()} == {"fr"}


def test_sample_is_bounded_and_dedupes_rows(spark):
    rows = [(i % 7, "same text", "en") for i in range(500)] + [(i, f"text {i}", "de") for i in range(3000)]
    names, part = lk.sampled(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 200)
    assert names == ["de", "en"] and 50 <= part.where("lang = 'de'").count() <= 150 and part.where("lang = 'en'").count() <= 7


def test_op13(spark, sf):
    rows = {r["doc_id"]: r for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    got = lk.op13_language_kernel(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    by_text = {}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in rows[r.doc_id]["text"] or ""))
        by_text.setdefault(rows[r.doc_id]["text"], set()).add((r.lang_pred, r.score))
    assert all(len(x) == 1 for x in by_text.values())
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == rows[r.doc_id]["lang"] for r in held) >= 0.97 * len(held)


def test_held_out_accuracy(spark):
    docs = spark.createDataFrame(corpus(600, 7), "doc_id long, text string, lang string")
    model = lk.fit(docs.where("doc_id < 300"))
    got = lk.predict(docs.where("doc_id >= 300"), model).join(docs, "doc_id").where("lang_pred = lang").count()
    assert got >= 297
