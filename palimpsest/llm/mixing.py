"""Mixing sources to target weights by Pareto order sampling [native].

A source's target, in words, is its part of the mix. Every document has expected copies of its own:
its importance (by default longer texts count for more) times a factor of its source, at most
`most`, such that the words expected of the source are its target. The whole part of it is certain copies. What is
left is the inclusion probability p of a fixed-size sample: with a uniform number u the document
has the rank u (1 - p) : (1 - u) p, random odds divided by inclusion odds, and the lowest ranks are taken.

The size of the sample is counted in words and sampled by octaves of document size, from the largest down. An octave takes the ranks
whose words come nearest to what is expected of it and what the octaves above took too little or
too much; so one long document can't miss the target, at any size of a source. u follows
from id and text, so reruns agree.

No source is ever sorted in one task. Bins of ranks give each octave a zone of words in which its cut must lie, whatever
the octaves above leave, and only the rows in that zone, two documents or so, are put in order.

Defined cases: a null text has size 0 and is taken as whole copies only; a null source is a source,
last in order; rows with equal id and text share a rank and are taken together; null ids are told apart by
text; importance that is null or not above 0 counts as the least; no rows give no rows; a source without words has
target 0. Columns of the input keep their names whatever they are: the operator's own start with __mix_.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import null_safe, stored, table, word_count

BINS = 4096
#: Steps of importance: a factor's sums are kept per source and step.
STEPS = 64


def uniform(key: Column, text: Column, seed: int) -> Column:
    """A number in (0, 1) from 52 bits of the MD5 of seed, id and text."""
    one = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return (F.conv(F.substring(F.md5(one), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(2**52))


def length_steps(size: Column) -> Column:
    """1 to STEPS: the default importance, half of the most at 256 words."""
    return F.floor(F.lit(STEPS) * size / (size + 256)).cast("long") + 1


def importance_steps(value: Column) -> Column:
    """Importance of any scale as powers of 2 in steps of an eighth."""
    return F.when(value > 0, F.pow(F.lit(2.0), F.floor(F.log2(value) * 8) / 8)).otherwise(F.lit(2.0**-60))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """A row per source: __mix_source, source_size, target.

    Sources by code point, null last, weigh `weights` in turn and share `share` of all sizes;
    a target stops at `most` times its source, the excess going to the others by weight. That
    fixed point is a water level: sources in order of limit : weight are full until the level
    that the rest would share is below their own. The sums run over sources, not documents.
    """
    by_name = W.orderBy(F.col("__mix_source").asc_nulls_last())
    per = sizes.groupBy("__mix_source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("n", F.row_number().over(by_name)).withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("n") - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("limit", F.col("source_size") * F.lit(float(most))).withColumn("full", F.col("limit") / F.col("w"))
    order = W.orderBy("full", "n")
    everyone = W.partitionBy()
    per = (
        per.withColumn("before", F.coalesce(F.sum("limit").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left", F.sum("w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("all", F.sum("source_size").over(everyone) * F.lit(float(share)))
        .withColumn("level", (F.col("all") - F.col("before")) / F.col("left"))
    )
    per = per.withColumn("water", F.min(F.when(F.col("full") > F.col("level"), F.struct(F.col("full"), F.col("n"), F.col("level")))).over(everyone)["level"])
    target = F.when(F.col("water").isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("w") * F.col("water")))
    return per.select("__mix_source", "source_size", target.alias("target"))


def factors(sizes: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """s, source_size, target, factor: expected copies are the least of `most` and factor times importance (null: all are at `most`).

    Sums by (source, importance) in falling order: the first importance below `most` when those above it are held at `most`.
    """
    per = sizes.groupBy("__mix_source", "w").agg(F.sum("size").alias("words"))
    rows = null_safe(targets.withColumnRenamed("__mix_source", "s"), per, [("s", "__mix_source")]).drop("__mix_source")
    order = W.partitionBy("s").orderBy(F.desc("w"))
    held = F.coalesce(F.sum("words").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    free = F.sum(F.col("w") * F.col("words")).over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    rows = rows.withColumn("held", held).withColumn("free", free).withColumn("c", F.when(F.col("free") > 0, (F.col("target") - F.lit(float(most)) * F.col("held")) / F.col("free")))
    own = F.when(F.col("c") * F.col("w") <= F.lit(float(most)), F.struct("w", "c"))
    return rows.groupBy("s").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.max(own)["c"].alias("factor"))


def ranked(sizes: DataFrame, factors_: DataFrame, most: float) -> DataFrame:
    """sizes with certain copies (whole), inclusion probability (p), rank (v, in (0, 1)) and octave (k) of those that are sampled."""
    rows = null_safe(sizes, factors_, [("__mix_source", "s")], "left").drop("s")
    copies = F.when(F.col("factor").isNull(), F.when(F.col("source_size") > 0, F.lit(float(most))).otherwise(0.0)).otherwise(F.least(F.lit(float(most)), F.col("factor") * F.col("w")))
    rows = rows.withColumn("copies", copies).withColumn("whole", F.floor("copies").cast("long"))
    p, u = F.col("copies") - F.col("whole"), F.col("u")
    odds = u * (1 - p)
    return rows.withColumn("p", p).withColumn("v", odds / (odds + (1 - u) * p)).withColumn("k", F.length(F.bin("size"))).withColumn("sampled", (F.col("p") > 0) & (F.col("size") > 0))


def octaves(rows: DataFrame) -> DataFrame:
    """s, k, expected, margin: for each source and octave the words expected of the sample, and how far the octaves from this one up may miss theirs.

    An octave misses by half a document at most, or by what is left for it beyond what it can give or take.
    """
    per = rows.where("sampled").groupBy(F.col("__mix_source").alias("s"), "k").agg((F.sum(F.floor(F.col("p") * F.col("size") * 1e6).cast("long")) / 1e6).alias("expected"), F.sum("size").alias("words"), F.max("size").alias("largest"))
    per = per.withColumn("slack", F.least(F.col("expected"), F.col("words") - F.col("expected")))
    down = W.partitionBy("s").orderBy(F.desc("k"))
    above = F.coalesce(F.sum("slack").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    per = per.withColumn("given", above).withColumn("miss", F.max(F.col("largest") / 2 + F.col("given") + F.col("slack")).over(down.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("given") - F.col("slack"))
    left = F.coalesce(F.lag("miss").over(down), F.lit(0.0))
    return per.select("s", "k", "expected", (left + F.col("largest") + 1).alias("margin"))


def zones(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """s, k, base, zone: the words before the zone of the octave's cut, and (v, words) of the rows in it in order of v.

    Sums by coarse bin, then by fine bin inside the coarse ones that the zone touches, then rows inside its fine bins.
    """

    def narrowed(part: DataFrame, bin_: Column, base: str) -> DataFrame:
        sums = part.groupBy("s", "k", bin_.alias("bin")).agg(F.sum("size").alias("words"), *[F.first(c).alias(c) for c in ("expected", "margin")], F.first(F.expr(base)).alias("base"))
        by = W.partitionBy("s", "k").orderBy("bin")
        sums = sums.withColumn("upto", F.col("base") + F.sum("words").over(by)).withColumn("below", F.col("upto") - F.col("words"))
        inside = sums.where((F.col("upto") > F.col("expected") - F.col("margin")) & (F.col("below") < F.col("expected") + F.col("margin")))
        return inside.groupBy("s", "k").agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"), F.min("below").alias("base"), F.first("expected").alias("expected"), F.first("margin").alias("margin"))

    fine = F.floor(F.col("v") * F.lit(float(BINS * BINS))).cast("long")
    rows = rows.where("sampled").select(F.col("__mix_source").alias("s1"), F.col("k").alias("k1"), "v", "size", fine.alias("fine"))
    near = lambda cut: null_safe(rows, cut, [("s1", "s"), ("k1", "k")])
    coarse = stored(narrowed(near(wanted), F.floor(F.col("fine") / BINS), "0L"), "mix-coarse")
    at = F.floor(F.col("fine") / BINS)
    exact = stored(narrowed(near(coarse).where((at >= F.col("lo")) & (at <= F.col("hi"))), F.col("fine"), "base"), "mix-fine")
    held = near(exact).where("fine between lo and hi").groupBy("s", "k", "v").agg(F.sum("size").alias("words"), F.first("base").alias("base"), F.first("expected").alias("expected"))
    return held.groupBy("s", "k").agg(F.first("base").cast("double").alias("base"), F.first("expected").alias("expected"), F.sort_array(F.collect_list(F.struct("v", "words"))).alias("zone"))


def cuts(found: DataFrame) -> DataFrame:
    """s2, k2, cut, at_cut: rows of the octave with v < cut are taken, and those with v = cut if at_cut. One fold per source, from the largest octave down."""
    per = found.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("k", "base", "expected", "zone")), asc=False).alias("o"))
    # open: no row has been passed over yet
    first = "named_struct('used', x.base, 'cut', x.zone[0].v, 'at_cut', false, 'open', true)"
    taken = "named_struct('used', r.used + z.words, 'cut', z.v, 'at_cut', true, 'open', true)"
    closed = "named_struct('used', r.used, 'cut', r.cut, 'at_cut', r.at_cut, 'open', false)"
    one = f"aggregate(x.zone, {first}, (r, z) -> if(r.open AND r.used + z.words / 2D <= a.left + x.expected, {taken}, {closed}))"
    step = f"aggregate(array({one}), a, (b, r) -> named_struct('left', b.left + x.expected - r.used, 'cuts', concat(b.cuts, array(named_struct('k', x.k, 'cut', r.cut, 'at_cut', r.at_cut)))))"
    start = "named_struct('left', 0D, 'cuts', cast(array() AS array<struct<k:int,cut:double,at_cut:boolean>>))"
    return per.selectExpr("s", f"explode(aggregate(o, {start}, (a, x) -> {step}).cuts) AS c").selectExpr("s AS s2", "c.k AS k2", "c.cut", "c.at_cut")


def plan(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(a row per source: its target and factor; a row per source and octave: its cut) from sizes: __mix_source, size, u, w."""
    targets = stored(source_targets(sizes, weights, share, most), "mix-targets")
    by_source = stored(factors(sizes, targets, most), "mix-factors")
    rows = ranked(sizes, by_source, most)
    wanted = stored(octaves(rows), "mix-octaves")
    return by_source, stored(cuts(zones(rows, wanted)), "mix-cuts")


def decided(sizes: DataFrame, by_source: DataFrame, by_octave: DataFrame, most: float = 2.0) -> DataFrame:
    """sizes with source_size, target, __mix_copies: what the plan says of each row."""
    rows = null_safe(ranked(sizes, by_source, most), by_octave, [("__mix_source", "s2"), ("k", "k2")], "left")
    extra = F.col("sampled") & ((F.col("v") < F.col("cut")) | ((F.col("v") == F.col("cut")) & F.col("at_cut")))
    return rows.withColumn("__mix_copies", F.col("whole") + F.when(extra, 1).otherwise(0)).drop("s2", "k2")


def measured(docs: DataFrame, seed: int, importance: str | None, *more: Column) -> DataFrame:
    """more columns of docs, __mix_source, __mix_id, size, u and w (importance) of each row."""
    own = [F.col("source").alias("__mix_source"), F.col("doc_id").alias("__mix_id"), word_count(F.col("text")).alias("size"), uniform(F.col("doc_id"), F.col("text"), seed).alias("u")]
    rows = docs.select(*more, *own, *([F.col(f"`{importance}`").cast("double").alias("w")] if importance else []))
    return rows.withColumn("w", importance_steps(F.col("w")) if importance else length_steps(F.col("size")))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 42, importance: str | None = None) -> DataFrame:
    """docs(doc_id, source, text, ...) as mixed: each row as often as the mix takes it.

    importance: a column that the expected copies of a source's rows are proportional to, up to `most`, in place of their length's;
    the words taken stay the source's target.
    """
    by_source, by_octave = plan(stored(measured(docs, seed, importance), "mix-sizes"), weights, share, most)
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__mix_row")
    taken = decided(measured(docs, seed, importance, held), by_source, by_octave, most).where("__mix_copies > 0")
    return taken.select("__mix_row", F.explode(F.sequence(F.lit(1), F.col("__mix_copies").cast("int"))).alias("__mix_copy")).select("__mix_row.*")


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    small = stored(measured(docs, 42, None), "mix-sizes")
    return decided(small, *plan(small)).select(F.col("__mix_id").alias("doc_id"), "size", "source_size", "target", (F.col("__mix_copies") * F.col("size")).alias("taken"))


#: The same by sorting every source: ranks in order, octave after octave.
ORACLE = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ((('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS n FROM d GROUP BY source),
s1 AS (SELECT *, [5.0, 2.0, 1.0][((n - 1) % 3 + 1)::INT]::DOUBLE AS w, source_size * 2.0::DOUBLE AS lim FROM s0),
s2 AS (SELECT *, lim / w AS fl FROM s1),
s3 AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(lim) OVER (ORDER BY fl, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY fl, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM s2),
s4 AS (SELECT *, (SELECT arg_min(lvl, (fl, n)) FROM s3 WHERE fl > lvl) AS water FROM s3),
s5 AS (SELECT source, source_size, CASE WHEN water IS NULL THEN lim ELSE least(lim, w * water) END AS target FROM s4),
r0 AS (SELECT d.*, 64 * size // (size + 256) + 1 AS w, s5.source_size, s5.target FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source),
i0 AS (SELECT source, w, first(target) AS target, sum(size)::BIGINT AS words FROM r0 GROUP BY source, w),
i1 AS (SELECT *, (target - 2.0::DOUBLE * coalesce(sum(words) OVER (PARTITION BY source ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
  / nullif(sum(w * words) OVER (PARTITION BY source ORDER BY w DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)::DOUBLE AS c FROM i0),
i2 AS (SELECT source, arg_max(c, w) FILTER (c * w <= 2.0) AS factor FROM i1 GROUP BY source),
r1 AS (SELECT r0.*, CASE WHEN factor IS NULL THEN CASE WHEN source_size > 0 THEN 2.0 ELSE 0.0 END ELSE least(2.0, factor * w) END::DOUBLE AS copies FROM r0 JOIN i2 ON r0.source IS NOT DISTINCT FROM i2.source),
r2 AS (SELECT *, floor(copies)::BIGINT AS whole, copies - floor(copies) AS p, length(bin(size)) AS k FROM r1),
r3 AS (SELECT *, (u * (1 - p)) / (u * (1 - p) + (1 - u) * p) AS v, p > 0 AND size > 0 AS sampled FROM r2),
e AS (SELECT source, k, sum(floor(p * size * 1e6)::BIGINT)::DOUBLE / 1e6 AS expected FROM r3 WHERE sampled GROUP BY source, k),
o0 AS (SELECT source, k, v, sum(size)::BIGINT AS words FROM r3 WHERE sampled GROUP BY source, k, v),
o AS (SELECT o0.*, e.expected, row_number() OVER (PARTITION BY o0.source ORDER BY o0.k DESC, v) AS i FROM o0 JOIN e ON o0.source IS NOT DISTINCT FROM e.source AND o0.k = e.k),
f AS (
  SELECT source, i, k, v, expected, 0.0::DOUBLE AS room, words / 2.0 <= expected AS took, CASE WHEN words / 2.0 <= expected THEN words ELSE 0 END::DOUBLE AS used FROM o WHERE i = 1
  UNION ALL
  SELECT source, i, k, v, expected, room, took, CASE WHEN took THEN used + words ELSE used END
  FROM (SELECT *, ok AND used + words / 2.0 <= room + expected AS took
    FROM (SELECT o.source, o.i, o.k, o.v, o.expected, o.words, CASE WHEN o.k = f.k THEN f.room ELSE f.room + f.expected - f.used END AS room,
      CASE WHEN o.k = f.k THEN f.used ELSE 0 END AS used, o.k <> f.k OR f.took AS ok
      FROM f JOIN o ON o.source IS NOT DISTINCT FROM f.source AND o.i = f.i + 1)))
SELECT r.doc_id, r.size, r.source_size, r.target, (r.size * (r.whole + CASE WHEN r.sampled AND f.took THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r3 r LEFT JOIN f ON r.source IS NOT DISTINCT FROM f.source AND r.k = f.k AND r.v = f.v AND r.sampled
"""
