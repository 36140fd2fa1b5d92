"""Quality rules with adaptive thresholds [native].

Each text is measured in one pass over its own arrays, without exploding words. Fixed rules drop
documents that are short or mostly repeat themselves. For the others the cutoffs adapt: KLL
quantile sketches of four ratios are built per language and source, and those of a language and of all documents are merged
from them. A document passes if every ratio is inside fences set REACH spreads beyond
an upper quantile and, for word lengths, its mirror image. The spread is the distance of the two.

Quantiles of a group are drawn to its language's, and those to all documents', by n : PRIOR, so a small group leans on
more rows than its own and a large one hardly, at every size by the same rule. A spread is at least LEAST_SHARE
of that of the language and of all, and at least LEAST_PART of the language's median, so a group of equal documents has one too. No cutoff is a constant: ratios of what most documents lack
count one more than there is, so that their quantiles follow the group's lengths instead of being zero. The cutoffs are joined to the documents.

Defined cases: a null text has no words and fails the fixed rules; null language or source is a
group; an empty table gives no rows; repeated rows count as rows and get equal verdicts; a text of any length is measured whole.
Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import no_space, null_safe, stored, table, words

#: Documents' worth of the wider group in a group's quantiles.
PRIOR = 30
REACH = 4.0
LEAST_SHARE = 0.5
LEAST_PART = {"word_len": 0.05, "symbols": 0.5, "dup_lines": 0.5, "repeats": 0.5}
#: Ratio name: (expression over the measures, upper quantile, whether low values fail too). Most documents
#: have no repeats, and good ones have some; junk by symbols is too common for a quantile near 1.
RATIOS = {
    "word_len": ("word_chars / n_words", 0.75, True),
    "symbols": ("(n_symbols + 1) / n_words", 0.75, False),
    "dup_lines": ("(n_dup_lines + 1) / n_words", 0.98, False),
    "repeats": ("(n_repeat_words + 1) / n_words", 0.98, False),
}


def repeat_words(w: Column) -> Column:
    """Words lying in 3-word windows that occur twice or more, over an array of words.

    Windows are hashed; a text whose hashes are all distinct is done. Otherwise (hash, place)
    pairs are sorted, equal neighbours mark repeated windows, and the union of the marked
    places' three-word spans is summed from their gaps.
    """
    n = F.size(w)
    at = F.sequence(F.lit(1), n - 2)
    hashes = F.transform(at, lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))
    return F.when(n < 4, F.lit(0)).otherwise(F.aggregate(F.array(hashes), F.lit(0), lambda _, h: _covered(h)))


def _covered(h: Column) -> Column:
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    again = lambda s: F.filter(s, lambda p, k: ((k > 0) & (F.get(s, k - 1)["x"] == p["x"])) | (F.get(s, k + 1)["x"] == p["x"]).eqNullSafe(True))
    marked = F.aggregate(F.array(pairs), F.array().cast("array<int>"), lambda _, s: F.sort_array(F.transform(again(s), lambda p: p["i"])))
    spans = lambda m: F.aggregate(F.transform(m, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(m, k + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    count = F.aggregate(F.array(marked), F.lit(0), lambda _, m: spans(m))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(count)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words and the four measures of the contract, base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "lang", "source", text.alias("t"), words(F.col("text")).alias("w"))
    rows = rows.select(
        "doc_id",
        "lang",
        "source",
        F.size("w").cast("long").alias("n_words"),
        F.length(no_space(F.col("t"))).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.aggregate(F.array(F.transform(F.filter(F.split("t", "\n"), lambda x: no_space(x) != ""), lambda x: F.xxhash64(x))), F.lit(0), lambda _, x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("w")).cast("long").alias("n_repeat_words"),
    )
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def sketches(rows: DataFrame) -> DataFrame:
    """Mergeable state: per language and source, the number of documents and a sketch of each ratio."""
    rows = rows.where("not base_failed")
    return rows.groupBy("lang", "source").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(F.expr(e), 800).alias(k) for k, (e, *_) in RATIOS.items()])


def merged(states: DataFrame, *by: str) -> DataFrame:
    return states.groupBy(*by).agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(k, 800).alias(k) for k in RATIOS])


def cutoffs(states: DataFrame) -> DataFrame:
    """lang_c, source_c and for each ratio its fences."""
    names = ["n", *RATIOS]
    wider = lambda df, i: [F.col(k).alias(f"{k}_{i}") for k in names]
    rows = null_safe(states, merged(states, "lang").select(F.col("lang").alias("lang2"), *wider(states, 2)), [("lang", "lang2")])
    rows = rows.withColumn("one", F.lit(1)).join(merged(states).where("n > 0").select(F.lit(1).alias("one"), *wider(states, 3)), "one")
    own, lang = F.col("n") / (F.col("n") + PRIOR), F.col("n_2") / (F.col("n_2") + PRIOR)

    def at(k: str, q: float, i: int) -> Column:
        """The quantile of all documents (3), of the language (2) or of the group (1), drawn to the next wider one."""
        x = F.kll_sketch_get_quantile_double(k if i == 1 else f"{k}_{i}", F.lit(q))
        return x if i == 3 else (own if i == 1 else lang) * x + (1 - (own if i == 1 else lang)) * at(k, q, i + 1)

    fences = []
    for k, (_, high, low) in RATIOS.items():
        spreads = [at(k, high, i) - at(k, 1 - high, i) for i in (1, 2, 3)]
        spread = F.greatest(spreads[0], LEAST_SHARE * spreads[1], LEAST_SHARE * spreads[2], LEAST_PART[k] * at(k, 0.5, 2))
        fences.append((at(k, high, 1) + REACH * spread).alias(f"{k}_max"))
        if low:
            fences.append((at(k, 1 - high, 1) - REACH * spread).alias(f"{k}_min"))
    return rows.select(F.col("lang").alias("lang_c"), F.col("source").alias("source_c"), *fences)


def judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """rows with kept: the fixed rules, then the joined cutoffs."""
    inside = F.lit(True)
    for k, (e, _, low) in RATIOS.items():
        inside = inside & (F.expr(e) <= F.col(f"{k}_max"))
        if low:
            inside = inside & (F.expr(e) >= F.col(f"{k}_min"))
    rows = null_safe(rows, limits, [("lang", "lang_c"), ("source", "source_c")], "left")
    return rows.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(inside, F.lit(True))))


def quality_filter(docs: DataFrame) -> DataFrame:
    """doc_id, measures and verdict of every row of docs(doc_id, lang, source, text)."""
    rows = stored(measured(docs), "quality-measures")
    limits = stored(cutoffs(stored(sketches(rows), "quality-sketches")), "quality-cutoffs")
    return judged(rows, limits)


def op9_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_filter(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
