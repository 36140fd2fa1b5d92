"""Periodic runs of words, and texts without the repeats.

A run is a stretch of words with smallest period q, at least min_exponent * q and min_length words
long, that no neighbouring word extends with that period. By the runs theorem each run has, under an order of
the words or its reverse, a root that is the longest Lyndon word at its place. So the words are scanned right to left with a stack of
places, once under each order: the longest Lyndon word at a place ends at the next place with a smaller suffix.
Suffixes are compared, and roots extended to both sides, by common extensions: rolling hashes are searched by
halves, and the words found are then compared themselves, so a run never rests on a hash. What is known to be equal at a
distance is kept, so that comparing within a long run costs one step. There is no suffix array.

Only stretches that can hold a run are scanned: all of a run's triples of words occur min_exponent - 1 times in it or more,
so words that no such triple covers are in no run (triples are counted by hashes, which can only keep too much).

Each text is worked on where it lies: there is no shuffle. Words become numbers a megabyte of text at a time, so
beside the text a long one costs its numbers (some tens of bytes a word in stretches that repeat) and its distinct words.

Defined cases: null and empty texts have no words and no runs, and collapse to the empty text; a null doc_id is kept and
counts as empty text where the query takes its crc32; equal rows give equal rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import given_back, table, words

GAP = re.compile(rb"[\x20\x09-\x0D]")
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
MASK = (1 << 64) - 1


class Numbers(dict):
    """Words to numbers, in order of first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def parts(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, about a megabyte of it at a time."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            gap = GAP.search(text, end)
            end = gap.start() if gap else len(text)
        yield text[at:end].split()
        at = end


def numbered(text: bytes) -> tuple[np.ndarray, Numbers]:
    numbers = Numbers()
    found = [np.array(list(map(numbers.__getitem__, p)), np.int32) for p in parts(text)]
    return np.concatenate(found) if found else np.empty(0, np.int32), numbers


class Extensions:
    """How far words agree to the right or left of two places."""

    def __init__(self, w: np.ndarray) -> None:
        self.w, self.n, self.words, self.known, self.sums = w, len(w), w.tolist(), {}, None

    def _hashes(self) -> None:
        value = (self.w.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
        powers = np.full(self.n + 1, 0xD1342543DE82EF95, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(value * powers[:-1], out=sums[1:])
        self.sums, self.powers = memoryview(sums), memoryview(powers)

    def _same(self, i: int, j: int, n: int) -> bool:
        s = self.sums
        return ((s[i + n] - s[i]) * self.powers[j - i] - s[j + n] + s[j]) & MASK == 0

    def _search(self, i: int, j: int, low: int, stop: int, side: int) -> int:
        """Largest n up to stop with n equal words from i and j on (side 1) or before them (side -1); low are equal already."""
        if self.sums is None:
            self._hashes()
        same = (lambda n: self._same(i, j, n)) if side > 0 else (lambda n: self._same(i - n, j - n, n))
        first, high = low, min(stop, 2 * low)
        while high < stop and same(high):
            low, high = high, min(stop, 2 * high)
        if high == stop and same(high):
            low = stop
        while low + 1 < high and low < stop:
            mid = (low + high) // 2
            low, high = (mid, high) if same(mid) else (low, mid)
        # unlike hashes are of unlike words, so what was found can only be too long
        a, b = (self.w[i + first : i + low], self.w[j + first : j + low]) if side > 0 else (self.w[i - low : i - first][::-1], self.w[j - low : j - first][::-1])
        differ = a != b
        return first + int(differ.argmax()) if differ.any() else low

    def right(self, i: int, j: int) -> int:
        """Number of equal words from i and from j > i on."""
        low, high = self.known.get(j - i, (self.n, self.n))
        if low <= i <= high:
            return high - i
        w, stop, n = self.words, min(self.n - j, low - i) if i < low else self.n - j, 0
        few = min(8, stop)
        while n < few and w[i + n] == w[j + n]:
            n += 1
        if n == 8 and n < stop:
            n = self._search(i, j, n, stop, 1)
        if i + n == low:
            n = high - i
        if n >= 4:
            self.known[j - i] = (i, i + n)
        return n

    def left(self, i: int, j: int) -> int:
        """Number of equal words just before i and just before j > i."""
        w, n = self.words, 0
        few = min(8, i)
        while n < few and w[i - 1 - n] == w[j - 1 - n]:
            n += 1
        return self._search(i, j, n, i, -1) if n == 8 and n < i else n


def lyndon_ends(w: list[int], common: Extensions) -> list[int]:
    """For each place the end of the longest Lyndon word there: the next place with a smaller suffix, or the end."""
    n = len(w)
    ends, stack, right = [n] * n, [], common.right
    for i in range(n - 1, -1, -1):
        x = w[i]
        while stack:
            j = stack[-1]
            y = w[j]
            if y < x:
                break
            if y == x:
                k = right(i, j)
                if j + k == n or w[j + k] < w[i + k]:
                    break
            stack.pop()
        if stack:
            ends[i] = stack[-1]
        stack.append(i)
    return ends


def stretches(w: np.ndarray, min_length: int, times: int) -> list[tuple[int, int]]:
    """Where runs can be: whole stretches of words whose triples occur `times` or more in the stretch that they were found in."""
    if times < 2 or min_length < 3:
        return [(0, len(w))]
    todo, out = [(0, len(w), 0)], []
    while todo:
        a, z, level = todo.pop()
        if z - a < min_length:
            continue
        v = w[a:z].astype(np.uint64)
        key = (v[:-2] * np.uint64(0x9E3779B97F4A7C15) + v[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + v[2:]
        key = (key * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - (z - a).bit_length() - 3)
        key = key.astype(np.int64)
        keep = np.bincount(key)[key] >= times
        if level == 4 or keep.all():
            out.append((a, z))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[0], keep.view(np.int8), [0]]))).tolist()
        todo += [(a + s, a + e + 2, level + 1) for s, e in zip(edges[::2], edges[1::2], strict=True) if e - s + 2 >= min_length]
    return sorted(out)


def runs(w: np.ndarray, min_length: int = 6, min_exponent: int = 4) -> list[tuple[int, int, int]]:
    """start, length, period of each run of a row of numbers, in order of start and period."""
    found = set()
    for a, z in stretches(w, min_length, min(min_exponent - 1, min_length - 2)):
        v = w[a:z]
        common, n = Extensions(v), z - a
        for order in (common.words, [-x for x in common.words]):
            ends = np.array(lyndon_ends(order, common), np.int64)
            i = np.flatnonzero(ends < n)
            p = ends[i] - i
            for k in range(1, min_exponent):
                ok = i + k * p < n
                i, p = i[ok], p[ok]
                ok = v[i] == v[i + k * p]
                i, p = i[ok], p[ok]
            last = {}
            for x, q in zip(i.tolist(), p.tolist(), strict=True):
                if x < last.get(q, 0):
                    continue
                start, end = x - common.left(x, x + q), x + q + common.right(x, x + q)
                last[q] = end - q
                if end - start >= max(min_length, min_exponent * q):
                    found.add((a + start, end - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(text: bytes, w: np.ndarray, numbers: Numbers, found: list[tuple[int, int, int]]) -> bytes:
    """The words, a space between two, without those that a run holds after its first period."""
    if not found:
        return b" ".join(b" ".join(p) for p in parts(text))
    change = np.zeros(len(w) + 1, np.int32)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    kept, vocabulary = w[np.cumsum(change[:-1]) == 0], list(numbers)
    return b" ".join(b" ".join(map(vocabulary.__getitem__, kept[k : k + 65536].tolist())) for k in range(0, len(kept), 65536))


def find_runs(docs: DataFrame, min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """doc_id, n_words, runs (start, length, period by start, then period), collapsed for every row of docs."""
    if min_exponent < 2:
        raise ValueError("a run has an exponent of 2 or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, found, rest = [], [], []
            for text in b.column(1):
                raw = text.as_py()
                w, numbers = numbered(raw)
                r = runs(w, min_length, min_exponent)
                n.append(len(w))
                found.append([{"start": x, "length": y, "period": z} for x, y, z in r])
                rest.append(collapsed(raw, w, numbers, r).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(found, pa.list_(RUN)), pa.array(rest, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(given_back(run), SCHEMA)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text: a tenth of the documents, chosen by id, repeat their words with a period from a place on."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))

    def planted(x: Column) -> Column:
        # x holds the words once; named in a lambda, they aren't split again for each word
        n = F.size(x.w).cast("long")
        a = x.g % n
        p = 1 + F.floor((n - a) / (3 + x.g % 8))
        return F.when(n == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(x.w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " "))

    held = F.array(F.struct(words(F.col("text")).alias("w"), F.floor(h / 10).alias("g")))
    return docs.select("doc_id", F.when(h % 10 == 0, F.transform(held, planted)[0]).otherwise(F.col("text")).alias("text"))


def digest(rows: DataFrame) -> DataFrame:
    """Counts, the longest run and digests of find_runs' rows."""
    line: Column = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("l"), r.start.alias("s"), r.period.alias("p"))))
    rows = rows.select("*", best.alias("best"))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.s").alias("start"),
        (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"),
        F.expr("(-best.l * 1000) div best.p").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_runs(with_planted_runs(table(spark, sf_dir, "documents"))))
