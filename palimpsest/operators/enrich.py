"""Retention, entity resolution, link prediction, change observation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import split_identifier
from .literals import holding

# Half-lives in days, thresholds of actions.
HALF_LIFE_DAYS = {"intent": 30.0, "observation": 14.0, "reflection": 30.0, "cross_domain": 60.0, "prediction": 7.0}
ARCHIVE, PRUNE, REFRESH = 0.05, 0.15, 0.65
#: Rows of sets whose pairs one task makes, about.
SET_ROWS = 1 << 19


def retention_score(importance: Column, accesses: Column, last_access: Column, now: int, half_life_days: float) -> Column:
    age = F.greatest(F.lit(now) - last_access, F.lit(0))
    return importance * F.exp(-F.log(F.lit(2.0)) / (half_life_days * 86400) * age) * (1 + 0.2 * accesses)


def retention_action(score: Column, permanent: Column) -> Column:
    return F.when(permanent, "permanent").when(score < ARCHIVE, "archive").when(score < PRUNE, "prune").when(score < REFRESH, "refresh").otherwise("keep")


def should_promote(accesses: Column, last_access: Column, now: int) -> Column:
    return (accesses >= 10) & (F.lit(now) - last_access < 14 * 86400)


def co_occurrence(results: DataFrame, threshold: int = 3) -> DataFrame:
    """a, b, n, confidence for items of results(set_id, item) that share threshold sets or more.

    A set's items are compared in one array of its distinct items (sets are result lists of
    bounded length); pairs are counted with partial sums.
    """
    # tasks of some rows each: few bytes here make many pairs
    results = results.repartition(max(int(results.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-results.count() // SET_ROWS)), "set_id")
    sets = results.groupBy("set_id").agg(F.sort_array(F.collect_set("item")).alias("items")).where("size(items) > 1")
    pairs = sets.select(F.explode(F.flatten(F.transform("items", lambda a, i: F.transform(F.slice(F.col("items"), i + 2, F.size("items")), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    counts = pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("n")).where(F.col("n") >= threshold)
    return counts.withColumn("confidence", F.when(F.col("n") >= 3 * threshold, "likely").otherwise("unknown"))


@F.pandas_udf(DoubleType())
def jaro_winkler(a, b):
    """Jaro-Winkler similarity over characters; the prefix bonus always applies."""
    import pandas as pd

    def one(x: str, y: str) -> float:
        if x == y:
            return 1.0
        if not x or not y:
            return 0.0
        reach = max(max(len(x), len(y)) // 2 - 1, 0)
        free, ours = [True] * len(y), []
        for i, c in enumerate(x):
            for j in range(max(0, i - reach), min(len(y), i + reach + 1)):
                if free[j] and y[j] == c:
                    free[j] = False
                    ours.append(c)
                    break
        if not ours:
            return 0.0
        m = len(ours)
        theirs = [c for c, f in zip(y, free, strict=True) if not f]
        swaps = sum(p != q for p, q in zip(ours, theirs, strict=True)) / 2
        jaro = (m / len(x) + m / len(y) + (m - swaps) / m) / 3
        prefix = 0
        for p, q in zip(x[:4], y[:4], strict=False):
            if p != q:
                break
            prefix += 1
        return jaro + 0.1 * prefix * (1 - jaro)

    return pd.Series([one(x or "", y or "") for x, y in zip(a, b, strict=True)])


def word_jaccard(a: Column, b: Column) -> Column:
    x, y = (F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "") for c in (a, b))
    every = F.size(F.array_union(x, y))
    return F.when(every > 0, F.size(F.array_intersect(x, y)) / every).otherwise(0.0)


def entity_score(a: Column, b: Column, same_module: Column, sig_a: Column, sig_b: Column) -> Column:
    return 0.35 * jaro_winkler(a, b) + 0.35 * jaro_winkler(split_identifier(a), split_identifier(b)) + 0.15 * same_module.cast("double") + 0.15 * word_jaccard(sig_a, sig_b)


def resolution(score: Column) -> Column:
    return F.when(score > 0.92, "merge").when(score >= 0.75, "verify").otherwise("separate")


def distinct_names(rows: DataFrame) -> DataFrame:
    """names, normal: every two different names of rows(name), the lesser first, with the similarities that a score needs, each computed once.

    No block is lossless here: a score can pass on a single common letter. So the work grows with the square of the distinct
    names, not of the rows; names are dealt to tasks by hash and meet all names once.
    """
    names = rows.select("name").distinct()
    pairs = names.join(names.select(F.col("name").alias("other")), F.col("name") <= F.col("other"))
    return pairs.select("name", "other", (0.35 * jaro_winkler("name", "other") + 0.35 * jaro_winkler(split_identifier(F.col("name")), split_identifier(F.col("other")))).alias("alike"))


def resolved(entities: DataFrame, least: str = "verify") -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of entities(id, name, signature, module): pairs of classes that may be one entity, and each id's class.

    A class is a (name, signature), named by its smallest id; copies make no pairs. same_module says for which members a
    score holds: those that share a module, or those that don't. A class pairs with itself for its members of other modules or the same.
    """
    classes = entities.groupBy("name", "signature").agg(F.min("id").alias("class"))
    members = entities.join(classes, entities.name.eqNullSafe(classes.name) & entities.signature.eqNullSafe(classes.signature)).select("id", "class", "module")
    alike = distinct_names(classes)
    left = classes.select(F.col("name"), F.col("signature").alias("sig_a"), F.col("class").alias("a"))
    right = classes.select(F.col("name").alias("other"), F.col("signature").alias("sig_b"), F.col("class").alias("b"))
    both = left.join(alike, "name").join(right, "other")
    # equal names stand once among the pairs of names, so there the lesser class goes first
    both = both.where((F.col("name") < F.col("other")) | (F.col("a") <= F.col("b")))
    score = F.round(F.col("alike") + 0.15 * F.col("same").cast("double") + 0.15 * word_jaccard(F.col("sig_a"), F.col("sig_b")), 6)
    out = both.withColumn("same", F.explode(F.array(F.lit(True), F.lit(False)))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("same").alias("same_module"), score.alias("score"))
    out = out.withColumn("resolution", resolution(F.col("score")))
    return out.where(F.col("resolution") == "merge" if least == "merge" else F.col("resolution") != "separate"), members


def batch_scores(nodes: DataFrame, now: int, half_life_days: float = 14.0) -> DataFrame:
    """nodes(importance, accesses, last_access, permanent, ...) with score and action."""
    score = retention_score(F.col("importance"), F.col("accesses"), F.col("last_access"), now, half_life_days)
    return nodes.withColumn("score", score).withColumn("action", retention_action(F.col("score"), F.col("permanent")))


def retention_summary(scored: DataFrame) -> DataFrame:
    """One row: how many nodes of each action, all of them, and their mean score."""
    counts = [F.count_if(F.col("action") == a).alias(f"n_{a}") for a in ("permanent", "archive", "prune", "refresh", "keep")]
    return scored.agg(F.count("*").alias("n"), *counts, F.round(F.avg("score"), 6).alias("mean_score"))


def base_name(path: Column) -> Column:
    """A file's name without folder and last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "[/]"), -1), r"\.[^.]*$", "")


def tested_name(path: Column) -> Column:
    """A test file's name without the first of the marks of tests that it has; prefix test_ comes before suffixes, those before prefix test."""
    n = base_name(path)
    cut = F.when(F.startswith(n, F.lit("test_")), F.substring(n, 6, 1 << 30))
    for mark in ("_test", ".test", "_spec"):
        cut = cut.when(F.endswith(n, F.lit(mark)), F.left(n, F.length(n) - len(mark)))
    return cut.when(F.startswith(n, F.lit("test")), F.substring(n, 5, 1 << 30)).otherwise(n)


def test_impl_links(tests: DataFrame, impls: DataFrame) -> DataFrame:
    """src_path, dst_path, confidence: tests(file_path) to impls(file_path) whose name holds the tested name, or is held by it.

    Names are joined, not files: equal names of many files are one. They meet both ways under the rarest gram of what is held (literals.holding).
    """
    t = tests.select(F.col("file_path").alias("src_path"), tested_name(F.col("file_path")).alias("tested")).where(base_name(F.col("file_path")) != "")
    i = impls.select(F.col("file_path").alias("dst_path"), base_name(F.col("file_path")).alias("stem"))
    a, b = t.select("tested").distinct(), i.select("stem").distinct()
    one, two = holding(b, "stem", F.col("stem"), a, F.col("tested")), holding(a, "tested", F.col("tested"), b, F.col("stem"))
    pairs = one.select("tested", "stem").unionByName(two.select("tested", "stem")).distinct()
    return pairs.join(t, "tested").join(i, "stem").select("src_path", "dst_path", F.lit(1).alias("confidence"))


def detect_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """file, change, symbol, priority: symbols of rows(file, symbol[, at]) added or deleted; where neither, a file whose list differs is modified.

    A list differs by order (at) or by repeats. Modified rows name no symbol.
    """
    at = lambda df: F.col("at") if "at" in df.columns else F.lit(0)
    a, b = old.select("file", "symbol").distinct(), new.select("file", "symbol").distinct()
    added = b.join(a, ["file", "symbol"], "left_anti").withColumn("change", F.lit("added"))
    gone = a.join(b, ["file", "symbol"], "left_anti").withColumn("change", F.lit("deleted"))
    changes = added.unionByName(gone)
    # a list as one number: symbols hashed with their places, summed, so that no list is gathered
    listed = lambda df, name: df.groupBy("file").agg(F.sum(F.xxhash64(at(df), "symbol").cast("decimal(38,0)")).alias(name), F.count("*").alias(f"n_{name}"))
    both = listed(old, "o").join(listed(new, "w"), "file").where("o <> w or n_o <> n_w")
    same = both.join(changes.select("file").distinct(), "file", "left_anti").select("file", F.lit("modified").alias("change"), F.lit(None).cast(dict(changes.dtypes)["symbol"]).alias("symbol"))
    out = changes.select("file", "change", "symbol").unionByName(same)
    priority = F.when(F.col("change") == "deleted", "high").when(F.col("change") == "added", "medium").otherwise("low")
    return out.withColumn("priority", priority)


def common_prefix(low: Column, high: Column) -> Column:
    """The folders that the least and the greatest of some paths (as arrays of parts) share, and so all between; a single path's folder."""
    n = F.least(F.size(low), F.size(high))
    same = F.filter(F.sequence(F.lit(0), n), lambda i: (i < n) & ~F.get(low, i.cast("int")).eqNullSafe(F.get(high, i.cast("int"))))
    upto = F.least(F.coalesce(F.array_min(same), n), F.when(low == high, F.size(low) - 1).otherwise(n)).cast("int")
    return F.array_join(F.slice(low, 1, upto), "/")


def reflection(changes: DataFrame, *by: str) -> DataFrame:
    """Counts by change, files, the pattern that they show, their scope, and the last time where there is one."""
    parts = F.split("file", "/")
    latest = [F.max("ts").alias("latest")] if "ts" in changes.columns else []
    rows = changes.groupBy(*by).agg(
        F.count_if(F.col("change") == "added").alias("n_added"),
        F.count_if(F.col("change") == "modified").alias("n_modified"),
        F.count_if(F.col("change") == "deleted").alias("n_deleted"),
        F.count_distinct("file").alias("n_files"),
        F.min(parts).alias("low"),
        F.max(parts).alias("high"),
        *latest,
    )
    pattern = (
        F.when(F.col("n_added") > F.col("n_modified") + F.col("n_deleted"), "feature_addition")
        .when(F.col("n_deleted") > F.col("n_added") + F.col("n_modified"), "cleanup")
        .when((F.col("n_modified") > 0) & (F.col("n_added") == 0) & (F.col("n_deleted") == 0), "refactoring")
        .otherwise("mixed_changes")
    )
    prefix = common_prefix(F.col("low"), F.col("high"))
    scope = F.when(F.col("n_files") == 1, F.array_join("low", "/")).when(prefix == "", "multiple modules").otherwise(prefix)
    return rows.withColumn("pattern", pattern).withColumn("scope", scope).drop("low", "high")


# Priorities of enrichment tasks, the most urgent last.
PRIORITIES = ("background", "low", "medium", "high", "critical")


def next_tasks(tasks: DataFrame, done: DataFrame, n: int) -> DataFrame:
    """The n most urgent of tasks(node_id, source_hash, version, task_type, priority) whose result the cache done(key) lacks."""
    from ..functions.nodes import cache_key

    rank = F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.col("priority"))
    rows = tasks.withColumn("key", cache_key(F.col("node_id"), F.col("source_hash"), F.col("version"))).join(done.select("key").distinct(), "key", "left_anti")
    return rows.orderBy(rank.desc(), "node_id", "task_type").limit(n)


def cached(old: DataFrame, written: DataFrame, most: int = 10_000) -> DataFrame:
    """The cache old(key, value, node_id, source_hash, at) after new entries: a key's last one, of all the `most` last written.

    The cut is found by counts per time, so entries aren't sorted but those written at the cut.
    """
    order = W.partitionBy("key").orderBy(F.desc("at"))
    rows = old.unionByName(written).withColumn("__rn", F.row_number().over(order)).where("__rn = 1").drop("__rn")
    per = rows.groupBy(F.col("at").alias("t")).agg(F.count("*").alias("n"))
    newer = per.withColumn("newer", F.coalesce(F.sum("n").over(W.orderBy(F.desc("t")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).where(F.col("newer") < most)
    near = rows.join(newer, rows["at"] == newer["t"])
    ranked = near.withColumn("__k", F.when(F.col("newer") + F.col("n") > most, F.row_number().over(W.partitionBy("t").orderBy("key"))).otherwise(0))
    return ranked.where(F.col("__k") + F.col("newer") <= most).select(*rows.columns)


def invalidated(cache: DataFrame, nodes: DataFrame) -> DataFrame:
    """The cache without entries of nodes(node_id, source_hash) whose source has changed."""
    now = nodes.select("node_id", F.col("source_hash").alias("now"))
    return cache.join(now, "node_id", "left").where(F.col("now").isNull() | (F.col("source_hash") == F.col("now"))).drop("now")
