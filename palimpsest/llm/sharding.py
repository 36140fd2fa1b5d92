"""Sharding by minimax contiguous partition [native].

Documents with equal texts are one atomic group. Groups stand in the order of a 64-bit hash of
the text. A binary search finds the smallest shard capacity for which greedy filling in that order needs no more than the given
number of shards; cuts go no farther than that capacity allows, as near to equal shares of what is left as it lets them.
The law is `bytes`: sizes near equal, no shard above the smallest feasible capacity.

Sizes are summed by the top bits of the hash first: atoms of whole groups, 2^BITS at most. Greedy filling at the least and
at the found capacity bounds where each cut can lie; only atoms there are split by STEP more bits, and the search
runs again, until each of them is a single group. So the capacity is that of the groups themselves,
while no more than some thousand sums meet in one row, where the search runs as nested folds over prefix
sums. The driver reads back cut points and ranges, which become literals. The slots inside a shard are counted
in CHUNKS parts by id hash, so that neither a shard nor a group of copies is sorted in one task.

Defined cases: a null text is a text of no bytes; an empty table gives no rows; with fewer
groups than shards some shards stay empty; a group larger than an equal share has a shard whose
size is at least that group's (groups are never split); repeated rows are rows; a text's length doesn't matter beyond its size. Input columns keep their
names, but columns shard and slot, which the operator's replace; the operator's own start with __sh_.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import null_safe, stored, table, utf8_bytes

BITS, STEP = 16, 8
CHUNKS = 1024


def group_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def solve(atoms: DataFrame, shards: int) -> DataFrame:
    """One row from atoms(k, size), k being an atom's first key: capacity long, cuts array (the first key of shards 1, 2, ..., null for none), lows and highs arrays.

    Every greedy cut at the capacity or below, down to the least that the total allows, lies in the atoms from lows[j] to before highs[j] (null for the end).

    p[i] is the prefix sum of the first i atoms. reach(x) is the largest i with p[i] <= x, by
    bisection. back[j] is the smallest cut from which the last j shards can hold the rest.
    """
    sums = atoms.withColumn("p", F.sum("size").over(W.orderBy("k")))
    row = sums.groupBy().agg(F.sort_array(F.collect_list(F.struct("k", "p"))).alias("a"), F.max("size").alias("largest"), F.ceil(F.log2(F.count("*") + 2)).cast("int").alias("turns"))
    row = row.where("size(a) > 0").selectExpr("transform(a, x -> x.k) AS ks", "concat(array(0L), transform(a, x -> x.p)) AS p", "largest", "a[size(a) - 1].p AS total", "turns")

    def reach(x: str) -> str:
        return f"aggregate(sequence(0, turns), named_struct('lo', 0, 'hi', size(p) - 1), (s, _) -> if(p[(s.lo + s.hi + 1) div 2] <= {x}, named_struct('lo', cast((s.lo + s.hi + 1) div 2 as int), 'hi', s.hi), named_struct('lo', s.lo, 'hi', cast((s.lo + s.hi + 1) div 2 - if(s.lo < s.hi, 1, 0) as int))), s -> s.lo)"

    def reach_up(x: str) -> str:
        """The smallest i with p[i] >= x."""
        return f"if({x} <= 0, 0, {reach(f'({x} - 1)')} + 1)"

    fits = f"aggregate(sequence(1, {shards}), 0L, (c, _) -> p[{reach('(c + (b.lo + b.hi) div 2)')}]) = total"
    least = f"greatest(largest, (total + {shards - 1}) div {shards})"
    search = f"aggregate(sequence(1, 64), named_struct('lo', {least}, 'hi', {least} + largest), (b, _) -> if(b.lo >= b.hi, b, if({fits}, named_struct('lo', b.lo, 'hi', (b.lo + b.hi) div 2), named_struct('lo', (b.lo + b.hi) div 2 + 1, 'hi', b.hi))), b -> b.lo)"
    row = row.selectExpr("ks", "p", "total", "turns", f"{search} AS capacity")
    back = f"aggregate(sequence(1, {shards}), array(size(p) - 1), (r, _) -> concat(r, array({reach_up('(p[element_at(r, -1)] - capacity)')})))"
    # where greedy filling at the least capacity ends, atoms rounded down, and at the found one, rounded up
    low = f"aggregate(sequence(1, {shards - 1}), array(0), (c, _) -> concat(c, array({reach(f'(p[element_at(c, -1)] + (total + {shards - 1}) div {shards})')})))"
    high = f"aggregate(sequence(1, {shards - 1}), array(0), (c, _) -> concat(c, array(least({reach('(p[element_at(c, -1)] + capacity)')} + 1, size(p) - 1))))"
    row = row.selectExpr("ks", "p", "total", "turns", "capacity", f"{back} AS back", f"{low} AS low", f"{high} AS high")
    wish = f"(p[element_at(c, -1)] + (total - p[element_at(c, -1)]) div ({shards} - j + 1))"
    near = f"({reach(wish)} + if(size(p) - 1 > {reach(wish)} AND p[{reach(wish)} + 1] - {wish} < {wish} - p[{reach(wish)}], 1, 0))"
    most = reach("(p[element_at(c, -1)] + capacity)")
    ends = f"aggregate(sequence(1, {shards}), array(0), (c, j) -> concat(c, array(cast(greatest(least({near}, {most}), back[{shards} - j]) as int))))"
    row = row.selectExpr("ks", "capacity", "low", "high", f"{ends} AS ends")
    keys = lambda at: f"transform({at}, i -> get(ks, i))"
    return row.selectExpr("capacity", f"{keys(f'slice(ends, 2, {shards - 1})')} AS cuts", f"{keys('slice(low, 2, size(low))')} AS lows", f"{keys('slice(high, 2, size(high))')} AS highs")


def atoms_of(groups: DataFrame, bits: int) -> DataFrame:
    """k (first key), last, size of the atoms that the top bits of the keys make of rows(key, size)."""
    return groups.groupBy(F.shiftright("key", 64 - bits).alias("top")).agg(F.min("key").alias("k"), F.max("key").alias("last"), F.sum("size").alias("size")).drop("top")


def within(key: Column, ranges: list[tuple[int, int | None]]) -> Column:
    out = F.lit(False)
    for a, b in ranges:
        out = out | ((key >= a) & (key < b) if b is not None else key >= a)
    return out


def merged(ranges: list[tuple[int, int | None]]) -> list[tuple[int, int | None]]:
    out: list[tuple[int, int | None]] = []
    for a, b in sorted(ranges, key=lambda r: r[0]):
        if out and (out[-1][1] is None or a <= out[-1][1]):
            end = None if b is None or out[-1][1] is None else max(b, out[-1][1])
            out[-1] = (out[-1][0], end)
        else:
            out.append((a, b))
    return out


def cut_points(groups: DataFrame, shards: int) -> list[int]:
    """The first keys of the shards but the first, from rows(key, size); fewer where shards stay empty at the end."""
    if shards < 2:
        return []
    atoms, bits = stored(atoms_of(groups, BITS), "shard-atoms"), BITS
    while True:
        found = solve(atoms.select("k", "size"), shards).first()
        if found is None:
            return []
        # equal bounds name no atom: the cut is known already
        ranges = merged([(a, b) for a, b in zip(found.lows, found.highs, strict=True) if a is not None and a != b])
        if bits == 64 or not ranges or atoms.where(within(F.col("k"), ranges) & (F.col("k") != F.col("last"))).isEmpty():
            return [c for c in found.cuts if c is not None]
        bits = min(64, bits + STEP)
        kept = atoms.where(~within(F.col("k"), ranges))
        atoms = stored(kept.unionByName(atoms_of(groups.where(within(F.col("key"), ranges)), bits)), "shard-atoms")


def shard_of(key: Column, cuts: list[int]) -> Column:
    out = F.lit(0)
    for c in cuts:
        out = out + F.when(key >= c, 1).otherwise(0)
    return out.cast("int")


def numbered(rows: DataFrame) -> DataFrame:
    """rows(__sh_shard, __sh_id, __sh_crc, ...) with __sh_slot, gapless from 0 in each shard."""
    rows = rows.withColumn("__sh_chunk", F.pmod(F.xxhash64("__sh_id", "__sh_crc"), F.lit(CHUNKS)).cast("int"))
    counts = rows.groupBy("__sh_shard", "__sh_chunk").agg(F.count("*").alias("n"))
    before = W.partitionBy("__sh_shard").orderBy("__sh_chunk").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(F.col("__sh_shard").alias("s1"), F.col("__sh_chunk").alias("c1"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__sh_start"))
    inside = W.partitionBy("__sh_shard", "__sh_chunk").orderBy("__sh_id", "__sh_crc")
    rows = rows.withColumn("__sh_at", F.row_number().over(inside))
    rows = null_safe(rows, starts, [("__sh_shard", "s1"), ("__sh_chunk", "c1")])
    return rows.withColumn("__sh_slot", (F.col("__sh_start") + F.col("__sh_at") - 1).cast("long")).drop("s1", "c1", "__sh_start", "__sh_at", "__sh_chunk")


def slim(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").alias("__sh_id"), (utf8_bytes(F.col("text")) + 8).alias("__sh_size"), F.crc32(text.cast("binary")).alias("__sh_crc"), group_key(F.col("text")).alias("__sh_key"))


def grouped(small: DataFrame) -> DataFrame:
    return small.select(F.col("__sh_key").alias("key"), F.col("__sh_size").alias("size"))


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """docs(doc_id, text, ...) with shard int and slot long; a clashing column of docs, in any case, is replaced."""
    cuts = cut_points(grouped(stored(slim(docs), "shard-sizes")), shards)
    keep = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__sh_row"), F.col("doc_id").alias("__sh_id"), F.crc32(text.cast("binary")).alias("__sh_crc"), shard_of(group_key(F.col("text")), cuts).alias("__sh_shard"))
    return numbered(rows).select("__sh_row.*", F.col("__sh_shard").alias("shard"), F.col("__sh_slot").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 24) -> None:
    """One folder per shard; its files hold ranges of slots in order, as many as there are partitions, so a shard of any size is many tasks."""
    shard(docs, shards).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op5_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = stored(slim(table(spark, sf_dir, "documents")), "shard-sizes")
    cuts = cut_points(grouped(small), 24)
    rows = numbered(small.withColumn("__sh_shard", shard_of(F.col("__sh_key"), cuts)))
    return rows.select(
        F.col("__sh_id").alias("doc_id"),
        F.col("__sh_size").alias("size"),
        F.col("__sh_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("__sh_shard").alias("shard"),
        F.col("__sh_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
