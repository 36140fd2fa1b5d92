"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has a bit set where over half of the XXH64 values of the text's 3-word shingles
have it. Two fingerprints link at `distance` or fewer differing bits (an even number). Cut into distance + 3 blocks,
such a pair agrees on at least 3 of them, so it meets under one of the keys made of 3 blocks: 10 keys of 38 or 39 bits
for distance 2, 35 of 27 or 28 for distance 4. Equal fingerprints are one row from the start: a group of copies costs one.

Inside a key, small buckets are compared pair by pair. A bucket of more fingerprints than each has centers
is linked without pairs and just as exactly: each fingerprint names as centers itself and the fingerprints up to half the
distance away in the blocks outside of the key; two of them name a common one just if they are within
the distance, and all that name it are within the distance of each other, so a link to the
smallest of them keeps the components and every link of them holds.

Components come from large-star and small-star rounds over links between fingerprints, written
to the shared folder each round; nothing about single documents reaches the driver.

Defined cases: null and empty texts have fingerprint zero and link like any other; texts of one
or two words hash as one shingle; a text of any length is made into words and hashed a megabyte at a time; equal rows share a component; a null doc_id is not a name for
a component unless it has no other; an empty table gives no rows. dedupe tells rows apart by doc_id and
a hash of the text, so null or repeated ids cost no component its document.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import given_back, stored, table
from .periodic_runs import parts

DISTANCE = 2
#: Blocks that a key is made of.
KEY_BLOCKS = 3


def fingerprint(text: bytes) -> int:
    """The fingerprint of a UTF-8 text as a signed 64-bit number; about a megabyte of it is made into words at a time."""
    from xxhash import xxh64_intdigest

    n, counts, tokens = 0, np.zeros(64, np.int64), []

    def count(hashes: list[int]) -> None:
        nonlocal n
        n += len(hashes)
        counts[:] += np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)

    for part in parts(text.lower()):
        # shingles over a cut begin with the last two words before it
        tokens = tokens + part
        if len(tokens) < 3:
            continue
        joined = b" ".join(tokens)
        ends, at = [], -1
        for t in tokens:
            at += len(t) + 1
            ends.append(at)
        starts = [0, *[e + 1 for e in ends[:-3]]]
        count([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[2:], strict=True)])
        tokens = tokens[-2:]
    if not n and tokens:
        count([xxh64_intdigest(b" ".join(tokens), 42)])
    bits = np.packbits(counts * 2 > n, bitorder="little")
    return int(bits.view(np.int64)[0]) if n else 0


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(x.as_py()) for x in b.column(1)], pa.int64()), b.column(2)], names=["doc_id", "fp", "text_hash"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp, text_hash for every row. bytes.lower() maps A-Z only and bytes.split() splits at U+0020, U+0009 to U+000D."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(given_back(_fingerprints), "doc_id long, fp long, text_hash long")


def block_masks(distance: int = DISTANCE) -> list[int]:
    """For each key the bits it is made of: all choices of KEY_BLOCKS of distance + KEY_BLOCKS blocks."""
    blocks = distance + KEY_BLOCKS
    edges = [64 * k // blocks for k in range(blocks + 1)]
    own = [sum(1 << i for i in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(own, KEY_BLOCKS)]


def center_masks(mask: int, distance: int) -> list[int]:
    """What a fingerprint's centers differ from it by: up to half the distance of bits outside of the key."""
    free = [1 << i for i in range(64) if not mask >> i & 1]
    return [sum(c) for n in range(distance // 2 + 1) for c in combinations(free, n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """a, b: links between distinct fingerprints (fp) that connect all within the distance of each other."""
    if distance % 2:
        raise ValueError("the distance must be even")
    masks = block_masks(distance)
    centers = [center_masks(m, distance) for m in masks]
    limit = max(map(len, centers))
    tables = F.array(*[F.struct(F.lit(k).cast("byte").alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("key")) for k, m in enumerate(masks)])
    keyed = fps.select("fp", F.explode(tables).alias("x")).select("fp", "x.m", "x.key")
    sizes = keyed.groupBy("m", "key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = sizes.select(F.col("m").alias("m1"), F.col("key").alias("key1"), "n")
    # the planner takes exploded rows for as large as the fingerprints, so a broadcast of these would be a row for each key in the driver
    met = stored(keyed.hint("merge").join(sizes, (keyed.m == sizes.m1) & (keyed.key == sizes.key1)).select("fp", "m", "key", "n"), "simhash-met")
    small = met.where(F.col("n") <= limit)
    left, right = small.select(F.col("fp").alias("a"), "m", "key"), small.select(F.col("fp").alias("b"), "m", "key")
    near = left.join(right, ["m", "key"]).where((F.col("a") < F.col("b")) & (_distance(F.col("a"), F.col("b")) <= distance)).select("a", "b")
    # the centers' masks are a table: literals of them would not fit a plan
    spark = fps.sparkSession
    apart = spark.createDataFrame([(k, _signed(x)) for k, xs in enumerate(centers) for x in xs], "m1 int, bit long")
    large = met.where(F.col("n") > limit)
    named = large.join(F.broadcast(apart), large.m == apart.m1).select("fp", "m", F.col("fp").bitwiseXOR(F.col("bit")).alias("center"))  # thousands of rows, by the distance alone
    least = named.groupBy("m", "center").agg(F.min("fp").alias("a"), F.count("*").alias("k")).where("k > 1").select(F.col("m").alias("m1"), F.col("center").alias("c1"), "a")
    stars = named.join(least, (named.m == least.m1) & (named.center == least.c1)).where("a < fp").select("a", F.col("fp").alias("b"))
    return near.union(stars).distinct()


def components(edges: DataFrame, name: str = "simhash") -> DataFrame:
    """node, root: the smallest node of each component, by alternating large-star and small-star rounds.

    A round keeps as many links or fewer; rounds are logarithmic in the number of nodes. Each is written, and
    ends the loop when its links equal those before (their count and hash sum).
    """
    # links stand as (b, a) with a < b
    edges, before = stored(edges.select(F.col("b").alias("u"), F.col("a").alias("v")), f"{name}-links"), None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = stored(small, f"{name}-round")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def rooted(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp, text_hash, root (a fingerprint of the component), component_id (its smallest doc_id) for every row."""
    rows = stored(fingerprints(docs), "simhash-fps")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), distance))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    owner = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = stored(named.select("fp", "root").join(owner, "root").select(F.col("fp").alias("fp1"), "root", "component_id"), "simhash-components")
    return rows.join(by_fp, rows.fp == by_fp.fp1).select("doc_id", "fp", "text_hash", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id of the component) for every row."""
    return rooted(docs).select("doc_id", "fp", "component_id")


def dedupe(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The rows of docs with one document of each component: its smallest doc_id, and of rows equal in that one row.

    Of rows equal in doc_id and text one stays, whatever their other columns hold. Columns keep their names; the operator's own start with __sd_. Only ids and hashes are shuffled but for the join that keeps the chosen documents.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("x")
    kept = rooted(docs, distance).groupBy("root").agg(first).select("x.doc_id", "x.text_hash").select(key.alias("__sd_key"), F.col("text_hash").alias("__sd_text"))
    kept = stored(kept, "simhash-kept")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__sd_row"), key.alias("__sd_key"), F.xxhash64("text").alias("__sd_text"))
    return rows.join(kept, ["__sd_key", "__sd_text"], "left_semi").dropDuplicates(["__sd_key", "__sd_text"]).select("__sd_row.*")


def op3_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
