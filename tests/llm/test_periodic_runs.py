"""Periodic runs against definitions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from palimpsest.llm import periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_runs(w, min_length=6, min_exponent=4):
    """Every maximal stretch of a period, shortest periods first; one of a multiple of a run's period is no run."""
    n, found = len(w), []
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i < n - q:
            k = i
            while k < n - q and w[k] == w[k + q]:
                k += 1
            if k - i + q >= max(min_length, min_exponent * q) and not any(s <= i and i + (k - i + q) <= s + m and q % p == 0 for s, m, p in found):
                found.append((i, k - i + q, q))
            i = max(k, i) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def slow_collapsed(w, found):
    return " ".join(x for k, x in enumerate(w) if not any(s + q <= k < s + m for s, m, q in found))


def fibonacci(n):
    a, b = [1], [1, 0]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def thue_morse(n):
    return [k.bit_count() & 1 for k in range(n)]


@pytest.mark.parametrize(("length", "exponent"), [(6, 4), (4, 3), (2, 2)])
def test_runs(length, exponent):
    r = random.Random(5)
    rows = [fibonacci(200), thue_morse(200), [0] * 60, [0, 1] * 30, [], [1], [0] * 5, [0] * 6, [0, 0, 1] * 20 + [0, 0, 2] * 20]
    rows += [[r.randrange(k) for _ in range(r.randrange(80))] for k in (1, 2, 2, 3, 4) for _ in range(60)]
    for _ in range(60):
        block = [r.randrange(3) for _ in range(r.randint(1, 9))]
        rows.append([r.randrange(5) for _ in range(9)] + (block * 9)[: r.randint(2, 50)] + [r.randrange(3) for _ in range(5)] + block * 5)
    for w in rows:
        assert periodic_runs.runs(np.array(w, np.int32), length, exponent) == slow_runs(w, length, exponent), w


def test_long_rows_stay_near_linear():
    for w in (np.zeros(200_000, np.int32), np.tile(np.arange(1000, dtype=np.int32), 200), np.array(thue_morse(100_000), np.int32)):
        found = periodic_runs.runs(w)
        assert all((w[s : s + m - q] == w[s + q : s + m]).all() for s, m, q in found)
    assert periodic_runs.runs(np.tile(np.arange(1000, dtype=np.int32), 200)) == [(0, 200_000, 1000)]


def test_extensions_do_not_trust_hashes():
    """Thue-Morse words and their complements collide in hashes modulo powers of two; the words are compared."""
    t = thue_morse(1 << 12)
    w = np.array(t + [1 - x for x in t], np.int32)
    e = periodic_runs.Extensions(w)
    for i, j in [(0, 1 << 12), (1, 2049), (5, 4101), (0, 2048)]:
        n = next((k for k in range(len(w) - j) if w[i + k] != w[j + k]), len(w) - j)
        assert e._search(i, j, n if n < 1 else 1, len(w) - j, 1) == n if n > 1 else True
        assert e.right(i, j) == n


def test_parts_cut_between_words():
    text = b"ab cd\nef  " * 50 + b"x" * 90
    assert [w for p in periodic_runs.parts(text, 7) for w in p] == text.split()


def test_defined_cases(spark):
    rows = [(1, None, 0), (None, "", 1), (2, "a b " * 6, 2), (2, "a b " * 6, 2), (3, "  " * 7, 3)]
    got = periodic_runs.find_runs(spark.createDataFrame(rows, "doc_id long, text string, runs int")).collect()
    assert [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got] == [(1, 0, [], ""), (None, 0, [], ""), *[(2, 12, [(0, 12, 2)], "a b")] * 2, (3, 7, [(0, 7, 1)], " ")]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs.digest(periodic_runs.find_runs(periodic_runs.with_planted_runs(empty))).count() == 0
    null = spark.createDataFrame([(None, None)], "doc_id long, text string")
    r = periodic_runs.digest(periodic_runs.find_runs(periodic_runs.with_planted_runs(null))).first()
    none = hashlib.sha256(b"").hexdigest()
    assert tuple(r) == (None, 0, None, None, None, None, none, none)


def test_op11(spark, sf):
    want, planted = {}, 0
    for r in pq.read_table(f"{sf}/documents.parquet").to_pylist():
        w = WORD.findall(r["text"] or "")
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        found = slow_runs(w)
        s, m, q = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        want[r["doc_id"]] = (len(found), s, m, q, m and m * 1000 // q, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(slow_collapsed(w, found).encode()).hexdigest())
    got = periodic_runs.op11_periodic_runs(spark, sf).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    assert planted and sum(x[0] > 0 for x in want.values()) > planted // 2
