"""Benchmark decontamination by spaced-seed hashing.

Texts are lower-cased, ASCII punctuation counts as space, and words are hashed to 64 bits. A mask
selects some of a span of neighbouring words and ignores the others; its hash at every place of
every benchmark item is a seed. An item is in a document if some WINDOW aligned words of it, or
all where it has fewer, differ in at most one word in six. Masks 0 and 1 together hit any WINDOW words with two or fewer
substituted words, whatever their places; items of LEAST to WINDOW - 1 words are cut in one part more than words that may differ, and
a mask without gaps of that part's length hits the part that is left whole.

Documents are scanned once in Arrow batches against a Bloom filter of the seeds (its size follows the number of seeds up
to BITS_MOST bits, its false hits only cost work) with the masks that the items ask for; hits leave with the words around them,
and are joined to the seeds on the hash. Equal items are one class and so are equal surroundings of hits, of which one is
verified: copies of a passage cost one check, however many documents and items share it.

Defined cases: a null text has no words; items of fewer than LEAST words are too short to be
evidence and match nothing; repeated items and documents are rows like others, pairs are
distinct; null doc_id or item_id pairs like a value; a text of any length is scanned whole; empty tables give no
pairs. Other columns of either table, whatever their names, are not read; decontaminate keeps those of docs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import given_back, stored, table

#: Found by exhaustive trial: any 13 places with two gaps hold one of the first two without a gap at a 1. The others are for shorter items.
MASKS = ("111001011", "101100111", "111", "1111", "11111", "111111")
WINDOW = 13
LEAST = 5
#: Words kept on both sides of a hit; a window of WINDOW words around it needs WINDOW - 1.
AROUND = 16
BITS_MOST = 1 << 29
_PUNCTUATION = bytes(32 if chr(i) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else i for i in range(256))
LIST64 = pa.list_(pa.int64())


def word_hashes(text: str) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    tokens = text.lower().encode("utf-8", "surrogatepass").translate(_PUNCTUATION).split()
    return np.fromiter(map(xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def parts(n: int) -> list[tuple[int, int]]:
    """(mask, place) of each part of an item of LEAST to WINDOW - 1 words, one more than words that may differ."""
    k = n // 6 + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(MASKS.index("1" * (b - a)), a) for a, b in zip(cuts, cuts[1:], strict=False)]


def seed_hashes(words: np.ndarray, mask: int) -> np.ndarray:
    """The mask's hash at each place where it fits."""
    n = len(words) - len(MASKS[mask]) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, 0x9E3779B97F4A7C15 + mask, np.uint64)
    for i, c in enumerate(MASKS[mask]):
        if c == "1":
            out ^= words[i : i + n]
            out *= np.uint64(0x2545F4914F6CDD1D)
            out ^= out >> np.uint64(29)
    return out


def bloom_places(seeds: np.ndarray, bits: int) -> list[np.ndarray]:
    """Four bit numbers for each seed; bits is a power of two."""
    low, high = seeds & np.uint64(0xFFFFFFFF), seeds >> np.uint64(32) | np.uint64(1)
    return [(low + np.uint64(k) * high) & np.uint64(bits - 1) for k in range(4)]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat.astype(np.int64)))


def benchmark_words(benchmark: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _lists([word_hashes(x) for x in b.column(1).to_pylist()])], names=["item_id", "item"])

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "item_id long, item array<long>")


def benchmark_seeds(items: DataFrame) -> DataFrame:
    """seed, mask, class, at (place in the item)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, words in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                w = np.asarray(words.values).view(np.uint64)
                if len(w) >= WINDOW:
                    found = [(m, seed_hashes(w, m), None) for m in (0, 1)]
                else:
                    found = [(m, seed_hashes(w, m)[at : at + 1], at) for m, at in (parts(len(w)) if len(w) >= LEAST else [])]
                for m, s, at in found:
                    places = np.arange(len(s)) if at is None else np.array([at])
                    yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array([m] * len(s), pa.int32()), pa.array([item] * len(s), pa.int64()), pa.array(places, pa.int32())], names=["seed", "mask", "class", "at"])

    return items.mapInArrow(run, "seed long, mask int, class long, at int")


def bloom(seeds: DataFrame, n: int) -> np.ndarray:
    """The filter of n seeds as 64-bit words; built by bit_or on executors, at most BITS_MOST bits come here."""
    bits = 1 << 16
    while bits < 64 * n and bits < BITS_MOST:
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.concatenate(bloom_places(np.asarray(b.column(0)).view(np.uint64), bits)) if b.num_rows else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["k", "v"])

    out = np.zeros(bits // 64, np.uint64)
    rows = seeds.select("seed").mapInArrow(run, "k long, v long").groupBy("k").agg(F.bit_or("v").alias("v")).toArrow()
    out[np.asarray(rows.column(0).combine_chunks())] = np.asarray(rows.column(1).combine_chunks()).view(np.uint64) if rows.num_rows else 0
    return out


def hits(docs: DataFrame, filter_words: np.ndarray, masks: list[int]) -> DataFrame:
    """doc_id, around array (words), seeds array, places array (in around): a row per run of near hits."""
    sent = docs.sparkSession.sparkContext.broadcast(filter_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        bits = len(held) * 64
        for b in batches:
            ids, around, seeds, places = [], [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = word_hashes(text.as_py())
                found = []
                for m in masks:
                    s = seed_hashes(words, m)
                    at = np.arange(len(s))
                    for p in bloom_places(s, bits) if len(s) else []:
                        ok = (held[p[at] >> np.uint64(6)] >> (p[at] & np.uint64(63)) & np.uint64(1)).astype(bool)
                        at = at[ok]
                    if len(at):
                        found.append((at, s[at]))
                if not found:
                    continue
                at, s = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
                order = np.argsort(at, kind="stable")
                at, s = at[order], s[order]
                for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > 2 * AROUND) + 1):
                    lo, hi = max(0, at[part[0]] - AROUND), at[part[-1]] + max(map(len, MASKS)) + AROUND
                    ids.append(doc)
                    around.append(words[lo:hi])
                    seeds.append(s[part])
                    places.append(at[part] - lo)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _lists(around), _lists(seeds), _lists(places)], names=["doc_id", "around", "seeds", "places"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(given_back(run), "doc_id long, around array<long>, seeds array<long>, places array<long>")


def best_window(around: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int]:
    """(equal words, words) of the best WINDOW aligned places: item[i] stands at around[i + shift]."""
    size = min(WINDOW, len(item))
    lo, hi = max(0, -shift), min(len(item), len(around) - shift)
    if hi - lo < size:
        return 0, size
    same = np.concatenate([[0], np.cumsum(item[lo:hi] == around[lo + shift : hi + shift])])
    return int((same[size:] - same[:-size]).max()), size


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        same, size = [], []
        for around, item, shift in zip(b.column(2), b.column(3), b.column(4).to_pylist(), strict=True):
            s, n = best_window(np.asarray(around.values), np.asarray(item.values), shift)
            same.append(s)
            size.append(n)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(same, pa.int32()), pa.array(size, pa.int32())], names=["near", "class", "same", "size"])


def matched(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, near: the surroundings it holds), (near, class, same, size of each verified pair), (item_id, class of equal items)."""
    words = stored(benchmark_words(benchmark).withColumn("class", F.xxhash64("item")), "decon-words")
    items = stored(words.groupBy("class").agg(F.first("item").alias("item")), "decon-items")
    seeds = stored(benchmark_seeds(items.select("class", "item")), "decon-seeds")
    masks = seeds.groupBy("mask").agg(F.count("*").alias("n")).collect()
    found = stored(hits(docs, bloom(seeds, sum(r.n for r in masks)), sorted(r["mask"] for r in masks)).withColumn("near", F.xxhash64("around", "seeds", "places")), "decon-hits")
    texts = found.groupBy("near").agg(F.first("around").alias("around"), F.first("seeds").alias("seeds"), F.first("places").alias("places"))
    flat = texts.select("near", F.explode(F.arrays_zip("seeds", "places")).alias("h")).select("near", F.col("h.seeds").alias("seed"), F.col("h.places").alias("place"))
    pairs = flat.join(seeds, "seed").select("near", "class", (F.col("place") - F.col("at")).cast("int").alias("shift")).distinct()
    pairs = pairs.join(texts.select("near", "around"), "near").join(items, "class")
    checked = pairs.select("near", "class", "around", "item", "shift").mapInArrow(_verified, "near long, class long, same int, size int")
    return found.select("doc_id", "near"), checked.where("6 * (size - same) <= size"), words.select("item_id", "class")


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, same, size: each pair with its best aligned window."""
    held, checked, members = matched(docs, benchmark)
    best = checked.join(held, "near").groupBy("doc_id", "class").agg(F.max(F.struct("same", "size")).alias("x"))
    return best.join(members, "class").select("doc_id", "item_id", "x.same", "x.size").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text has no overlap with an item; a row is known by a hash of its doc_id and text."""
    key = F.xxhash64("doc_id", "text")
    held, checked, _ = matched(docs.select(key.alias("doc_id"), "text"), benchmark)
    bad = stored(held.join(checked.select("near").distinct(), "near", "left_semi").select(F.col("doc_id").alias("__dc_id")).distinct(), "decon-bad")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__dc_row"), key.alias("__dc_key"))
    return rows.join(bad, F.col("__dc_key") == F.col("__dc_id"), "left_anti").select("__dc_row.*")


def op10_spaced_seed_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
