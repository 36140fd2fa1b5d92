"""Mixing, sharding, chat formatting and quality rules against brute force on small tables."""

import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import chat_format, mixing, quality_rules, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "own") for i, t, s in rows], DOCS).repartition(3)


def many(n=400):
    return [(i, " ".join(f"w{i * j % 97}" for j in range(1, 5 + i * i % 60)), ["a", "b", "c", None, "é"][i % 5] if i % 3 else "a") for i in range(n)]


def level(sizes):
    """Targets by resharing the excess by weight until none is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, out, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        full = {s for s in free if left * w[s] / sum(w[x] for x in free) > 2 * sizes[s]}
        if not full:
            out |= {s: left * w[s] / sum(w[x] for x in free) for s in free}
            break
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= full
    return out


def mixed(spark, rows):
    d = docs(spark, rows)
    small = mixing.measured(d, 42, None).cache()
    return mixing.decided(small, *mixing.plan(small)).collect()


def test_mix_targets_and_taken(spark):
    rows = many() + [(900, None, "b"), (901, "", "b"), (902, "  \t\n ", None), (903, "x " * 4000, "c")]
    got = mixed(spark, rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = level(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r.size == len(WORD.findall({i: t for i, t, _ in rows}[r["__mix_id"]] or ""))
        assert abs(r.target - want[r["__mix_source"]]) < 1e-6 * max(1, r.target)
        assert r["__mix_copies"] <= 2
        taken[r["__mix_source"]] += r["__mix_copies"] * r.size
    for s in want:
            assert abs(taken[s] - want[s]) <= (0.2 if s == "c" else 0.03) * want[s] + 60, (s, taken[s], want[s])
    assert [(r["__mix_id"], r["__mix_copies"]) for r in sorted(mixed(spark, rows), key=lambda r: r["__mix_id"])] == [(r["__mix_id"], r["__mix_copies"]) for r in sorted(got, key=lambda r: r["__mix_id"])]


def test_mix_keeps_columns_and_edge_cases(spark):
    out = mixing.mix(docs(spark, [(1, "a b c", "x"), (2, "d", "y"), (None, None, None), (2, "d", "y")]))
    assert out.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert out.count() > 0
    assert mixing.mix(docs(spark, []).limit(0)).count() == 0


def test_mix_inclusion_probabilities(spark):
    """Certain whole copies, then a sample of fixed size in which rows are as frequent as their importance says, up to 2."""
    r = random.Random(9)
    rows = [(i, " ".join(["w"] * r.choice([5, 30, 200, 900])), "a" if i < 4000 else "b") for i in range(4200)]
    d = docs(spark, rows).withColumn("n_chars", F.when(F.col("doc_id") % 4 == 0, 8.0).otherwise(F.when(F.col("doc_id") % 4 == 1, 1.0).otherwise(2.0)))
    for column in (None, "n_chars"):
        small = mixing.measured(d, 1, column).cache()
        got = mixing.decided(small, *mixing.plan(small)).collect()
        for source in "ab":
            own = [x for x in got if x["__mix_source"] == source]
            assert abs(sum(x["__mix_copies"] * x.size for x in own) - own[0].target) <= 3
            assert abs(sum(x.copies * x.size for x in own) - own[0].target) <= 1e-6 * own[0].target
            assert all(x.whole <= x["__mix_copies"] <= x.whole + (x.p > 0) <= 2 for x in own)
        by = defaultdict(list)
        for x in got:
            if x["__mix_source"] == "a":
                by[x.w].append(x)
        assert len(by) > 2 and len({round(xs[0].copies, 6) for xs in by.values()}) > 2
        for xs in by.values():
            mean, sd = xs[0].copies, (xs[0].p * (1 - xs[0].p) / len(xs)) ** 0.5
            assert abs(sum(x["__mix_copies"] for x in xs) / len(xs) - mean) <= 4 * sd + 0.02
    assert sorted(x.doc_id for x in mixing.mix(d, importance="n_chars").collect()).count(0) <= 2


def test_mix_rows_that_look_alike(spark):
    """Null and repeated ids with texts of their own are rows like others; equal rows are taken together; texts of any length."""
    rows = [(None, " ".join(f"n{i}" for _ in range(10 + i % 7)), "x") for i in range(300)] + [(7, f"seven {i} words", "y") for i in range(200)] + [(8, "same row", "z")] * 50 + [(9, "long " * 200_000, "z")]
    got = mixed(spark, rows)
    assert len(got) == len(rows)
    taken, target = Counter(), {}
    for r in got:
        taken[r["__mix_source"]] += r["__mix_copies"] * r.size
        target[r["__mix_source"]] = r.target
    assert abs(taken["x"] - target["x"]) <= 9 and abs(taken["y"] - target["y"]) <= 2 and abs(taken["z"] - target["z"]) <= 100_000
    assert len({r["__mix_copies"] for r in got if r["__mix_id"] == 8}) == 1


def minimax(sizes, k):
    """The smallest possible largest sum of k contiguous parts, by trying all cuts."""
    best = sum(sizes)
    for cut in combinations(range(1, len(sizes)), min(k, len(sizes)) - 1):
        c = [0, *cut, len(sizes)]
        best = min(best, max(sum(sizes[a:b]) for a, b in zip(c, c[1:])))
    return best


@pytest.mark.parametrize("sizes", [[5, 1, 1, 1, 9, 2, 2], [7], [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5], [100, 1, 1, 1]])
@pytest.mark.parametrize("k", [2, 4])
def test_shard_capacity_is_minimax(spark, sizes, k):
    groups = spark.createDataFrame([(i * 10, s) for i, s in enumerate(sizes)], "key long, size long")
    cuts = sharding.cut_points(groups, k)
    assert len(cuts) <= k - 1
    load = Counter()
    for i, s in enumerate(sizes):
        load[sum(i * 10 >= c for c in cuts)] += s
    assert max(load.values()) == minimax(sizes, k)


def capacity(sizes, k):
    """The smallest capacity at which greedy filling needs k parts or fewer."""

    def parts(c):
        n, used = 1, 0
        for s in sizes:
            n, used = (n + 1, s) if used + s > c else (n, used + s)
        return n

    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if parts(mid) <= k else (mid + 1, hi)
    return lo


@pytest.mark.parametrize("seed", range(4))
def test_shards_are_minimax_over_groups(spark, monkeypatch, seed):
    """With atoms of many groups, split where cuts can lie, the largest shard is as small as over the groups themselves."""
    monkeypatch.setattr(sharding, "BITS", 3)
    monkeypatch.setattr(sharding, "STEP", 3 + seed)
    r = random.Random(seed)
    keys = [r.getrandbits(64) - 2**63 if i % 3 else (5 << 58) + r.getrandbits(40) for i in range(900)]
    sizes = {k: r.choice([1, 10, 100]) * r.randint(1, 50) for k in keys}
    rows = [(k, s) for k, s in sizes.items()] + [(keys[0], 7)] * 9
    sizes[keys[0]] += 63
    cuts = sharding.cut_points(spark.createDataFrame(rows, "key long, size long"), 7)
    load = Counter()
    for k, s in sizes.items():
        load[sum(k >= c for c in cuts)] += s
    assert max(load.values()) == capacity([sizes[k] for k in sorted(sizes)], 7) and len(load) <= 7


def test_write_shards(spark, tmp_path):
    rows = many(300)
    sharding.write_shards(docs(spark, rows), f"{tmp_path}/shards", 6)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert {(x.doc_id, x.shard, x.slot) for x in back.collect()} == {(x.doc_id, x.shard, x.slot) for x in sharding.shard(docs(spark, rows).withColumns({"shard": F.lit("theirs"), "slot": F.lit("theirs")}), 6).collect()}


def test_shards(spark):
    rows = many(300) + [(1000 + i, "copy of one text", "a") for i in range(200)] + [(2000, None, "b"), (2001, "", "b"), (None, "z", None)]
    out = sharding.shard(docs(spark, rows), 6).collect()
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r)
    assert set(by) <= set(range(6))
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    places = defaultdict(set)
    for r in out:
        places[r.text or ""].add(r.shard)
    assert all(len(x) == 1 for x in places.values())
    load = [sum(len((r.text or "").encode()) + 8 for r in rs) for rs in by.values()]
    largest = 200 * (len("copy of one text") + 8)
    assert max(load) <= sum(load) / 6 + largest
    small = sharding.slim(docs(spark, rows)).collect()
    assert all(r["__sh_crc"] == zlib.crc32(({i: t for i, t, _ in rows}[r["__sh_id"]] or "").encode()) for r in small)
    assert sharding.shard(docs(spark, []).limit(0), 6).count() == 0


def conversation(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)


def test_chat_windows_round_trip(spark):
    odd = r"\### Assistant: </turn> ok \l \b \\n <turn n>x"
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", odd), (1, 2, "assistant", odd), (2, 0, "user", None), (2, 1, "assistant", ""), (3, None, None, "é\n</turn>\n"), (3, 5, "assistant", "a"), (3, 5, "assistant", "a")]
    rows += [(4, i, ["user", "assistant"][i % 2], f"text {i} " * (i % 40)) for i in range(700)]
    rows += [(6, 0, "system", "s" * 80), (6, 1, "user", "u" * 200), (6, 2, "assistant", "v" * 200), (6, 3, "user", "w" * 1700), (6, 4, "assistant", "x" * 3000), (6, 5, "user", None), (6, 6, "assistant", "y " * 100_000)]
    rows += [(5, 0, "system", "s" * 40), *[(5, i, ["user", "assistant"][i % 2], "word " * 120) for i in range(1, 30)]]
    own_names = {c: F.lit("theirs") for c in ("episode", "window", "ep", "p", "t", "sys", "back", "tok", "first", "formatted", "loss")}
    wins = chat_format.read_back(chat_format.windows(conversation(spark, rows).withColumns(own_names))).collect()
    byc = defaultdict(list)
    for w in sorted(wins, key=lambda w: (w.conv_id, w.episode, w.window)):
        byc[w.conv_id].append(w)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (-1 if r[1] is None else r[1]))
        turns = [(t.role, t.text) for w in byc[conv] for t in w.turns]
        assert turns == [(r[2] or "", r[3] or "") for r in own]
        assert [t for w in byc[conv] for t in w.targets] == [r[3] or "" for r in own if r[2] == "assistant"]
        for w in byc[conv]:
            assert (w.tokens > 512) == w.over_budget
            # what is over the budget has one new turn that wouldn't fit beside the system turn, and no history
            assert not w.over_budget or (w.n_new == 1 and "<turn h>" not in w.formatted)
            new = -(-len(w.turns[0].text.encode()) // 4) + 4
            assert not w.over_budget or new + (-(-len((own[0][3] or "").encode()) // 4) + 4 if own[0][2] == "system" else 0) > 512
    assert all("<turn s>system\n" + "s" * 40 in w.formatted or w.window + w.episode == 0 for w in byc[5] if "<turn n>system" not in w.formatted)
    assert any("<turn h>" in w.formatted for w in byc[4])
    assert chat_format.windows(conversation(spark, []).limit(0)).count() == 0


def measures(t):
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c, held = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if c[tuple(w[i : i + 3])] > 1:
            held |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(held)


def test_quality_measures(spark):
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a a a a", "a b c a b c", "x y z\nx y z\n\nx y z", "# * $ %&|<> é日本", "a b c d e f a b c q a b c", "line\n" * 30, "one two three " * 5000]
    texts += [" ".join(f"w{(i * j * j) % 13}" for j in range(i)) for i in range(3, 40)]
    got = quality_rules.measured(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measures(texts[r.doc_id] or ""), texts[r.doc_id][:40]


def test_quality_verdicts(spark):
    clean = [(i, " ".join(f"word{i * j % 1009}" for j in range(1, 80)), ["a", None, "b"][i % 3]) for i in range(1, 151)]
    junk = [(1000 + i, " ".join(f"wo{i * j % 1009}###" for j in range(1, 80)), "a") for i in range(5)]
    got = {r.doc_id: r for r in quality_rules.quality_filter(docs(spark, [*clean, *junk, (2000, "too short", "a"), (2001, None, None)])).collect()}
    assert all(got[i].kept for i, _, _ in clean)
    assert not any(got[i].kept for i, _, _ in junk)
    assert got[2000].base_failed and not got[2000].kept and not got[2001].kept
    assert quality_rules.quality_filter(docs(spark, []).limit(0)).count() == 0


def slow_kept(rows):
    """Verdicts with exact quantiles, by sorting each group: {id: kept}."""
    ms = {i: measures(t or "") for i, t, _ in rows}
    fails = {i: m[0] < 50 or 100 * m[4] > 50 * m[0] for i, m in ms.items()}
    ratio = {"word_len": lambda m: m[1] / m[0], "symbols": lambda m: (m[2] + 1) / m[0], "dup_lines": lambda m: (m[3] + 1) / m[0], "repeats": lambda m: (m[4] + 1) / m[0]}
    good = [(i, s) for i, _, s in rows if not fails[i]]
    cut = {}
    for s in {s for _, s in good}:
        group, every = [i for i, g in good if g == s], [i for i, _ in good]

        def at(q, ids, f):
            v = sorted(f(ms[i]) for i in ids)
            return v[max(0, -(-int(round(q * len(v) * 1e9)) // 10**9) - 1)]

        for k, f in ratio.items():
            high = 0.75 if k in ("word_len", "symbols") else 0.98
            w1, w2 = len(group) / (len(group) + 30), len(every) / (len(every) + 30)
            all_ = {q: at(q, every, f) for q in (high, 1 - high, 0.5)}
            lang = {q: w2 * x + (1 - w2) * x for q, x in all_.items()}
            own = {q: w1 * at(q, group, f) + (1 - w1) * lang[q] for q in (high, 1 - high)}
            spread = max(own[high] - own[1 - high], 0.5 * (lang[high] - lang[1 - high]), 0.5 * (all_[high] - all_[1 - high]), (0.05 if k == "word_len" else 0.5) * lang[0.5])
            cut[s, k] = (own[1 - high] - 4 * spread if k == "word_len" else -1, own[high] + 4 * spread)
    return {i: not fails[i] and all(cut[s, k][0] <= f(ms[i]) <= cut[s, k][1] for k, f in ratio.items()) for i, _, s in rows}


def test_quality_verdicts_with_exact_quantiles(spark):
    r = random.Random(3)
    rows = []
    for i in range(420):
        s = ["a", "b", None][i % 7 % 3]
        w = ["x" * max(1, int(r.gauss(4 if s == "a" else 7, 0.6))) + str(r.randrange(500)) for _ in range(r.randint(45, 150))]
        if i % 11 == 0:
            w = [x + "#" for x in w[:: r.randint(1, 4)]] + w
        if i % 13 == 0:
            w += w[: r.randint(3, len(w) // 2)]
        if i % 17 == 0:
            w = [x * r.randint(2, 4) for x in w]
        lines = [" ".join(w[k : k + 9]) for k in range(0, len(w), 9)]
        rows.append((i, "\n".join(lines + lines[: i % 5 if i % 19 == 0 else 0]), s))
    rows += [(500, None, "a"), (501, "", None), (502, rows[0][1], rows[0][2]), (503, "word " * 30_000, "b"), (504, " ".join(f"{j:06d}" for j in range(30_000)), "b")]
    d = docs(spark, rows).withColumns({c: F.lit("theirs") for c in ("n_words", "kept", "t", "w", "word_len", "lang_c", "one", "n")})
    got = {x.doc_id: x.kept for x in quality_rules.quality_filter(d).collect()}
    assert got == slow_kept(rows) and 20 < sum(not k for k in got.values()) < 200


def test_quality_cutoffs_follow_the_group(spark):
    """The same long words fail in a group where all words are alike and pass in one where they differ."""
    text = lambda mean: " ".join(f"{j:0{int(mean) + (j % 100 < 100 * (mean % 1))}d}" for j in range(200))
    rows = [(i, text(5), "tight") for i in range(60)] + [(100 + i, text(4 + i / 15), "wide") for i in range(60)]
    rows += [(300, text(7.5), "tight"), (301, text(7.5), "wide")]
    got = {r.doc_id: r.kept for r in quality_rules.quality_filter(docs(spark, rows)).collect()}
    assert [i for i, kept in got.items() if not kept] == [300]


def test_oracles(spark, sf):
    """The queries with SQL agree with it."""
    duckdb = pytest.importorskip("duckdb")
    from palimpsest.llm import queries

    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, sf)
        cols = sorted(df.columns)
        want = c.execute(sql).df()[cols]
        got = df.select(*cols).toPandas()
        assert sorted(map(str, got.itertuples(index=False, name=None))) == sorted(map(str, want.itertuples(index=False, name=None))), name


def test_digests_of_planted_conversation(spark, sf):
    got = chat_format.op6_chat_windows(spark, sf).where(F.col("conv_id") == -7).first()
    text = r"\### Assistant: </turn> ok"
    assert got.n_turns == 2 and got.loss_chars == len(text)
    assert got.turns_sha256 == sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert got.loss_sha256 == sha256(text.encode()).hexdigest()
