"""Steps between fusion and anchors. Ranked rows: query_id, node_id, score, rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths
from .literals import held


def reranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("node_id"))))


def with_nodes(rows: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """Ranked rows with columns of their node, null where it is unknown."""
    return rows.join(nodes.select("node_id", *columns), "node_id", "left")


def drop_noncode(rows: DataFrame) -> DataFrame:
    """rows(file_path, ...) without documentation; unknown nodes stay."""
    return rows.where(F.col("file_path").isNull() | ~paths.is_noncode_file(F.col("file_path")))


def literal_score(query: Column) -> Column:
    """The best of the ways in which a node's columns hold the whole query; 0 for none."""
    q = F.lower(F.trim(query))
    has = lambda c: F.contains(F.lower(F.col(c)), q)
    return F.greatest(
        F.when(F.lower("name") == q, 0.06).otherwise(0.0),
        F.when(has("signature"), 0.05).otherwise(0.0),
        F.when(has("doc_comment"), 0.04).otherwise(0.0),
        F.when(has("text"), 0.035).otherwise(0.0),
        F.when(has("file_path"), 0.025).otherwise(0.0),
        F.when(has("name"), 0.02).otherwise(0.0),
    )


def literal_boost(rows: DataFrame, nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """Adds literal_score to ranked rows and injects matching nodes that weren't ranked, for literal-like queries.

    Literals may stand anywhere in a text; nodes meet them under their rarest grams (literals.held).
    """
    from ..functions.text import is_literal_like

    literal = queries.where(is_literal_like(F.col("text"))).select("query_id", F.lower(F.trim("text")).alias("literal"))
    columns = ("name", "signature", "doc_comment", "text", "file_path")
    found = held(nodes.select("node_id", *columns), F.lower(F.concat_ws("\n", *columns)), literal.select("literal").distinct())
    # scored before it moves to its queries
    found = found.select("node_id", F.col("__found").alias("literal"), literal_score(F.col("__found")).alias("boost")).where("boost > 0")
    found = found.join(literal, "literal").select("query_id", "node_id", "boost")
    out = rows.select("query_id", "node_id", "score").join(found, ["query_id", "node_id"], "full_outer")
    return reranked(out.select("query_id", "node_id", F.round(F.coalesce("score", F.lit(0.0)) + F.coalesce("boost", F.lit(0.0)), 6).alias("score")))


def path_boost(score: Column, path: Column, mentioned: Column, boost: float = 0.05) -> Column:
    """score, more by boost if the path holds one of the mentioned paths."""
    return score + F.when(F.coalesce(F.exists(mentioned, lambda m: F.contains(paths.slashed(path), m)), F.lit(False)), boost).otherwise(0.0)


def boosted_by_paths(rows: DataFrame, queries: DataFrame, boost: float = 0.05) -> DataFrame:
    """rows(query_id, node_id, file_path, score) with path_boost by the paths that queries(query_id, text) mention."""
    from ..functions.queries import file_paths

    asked = queries.select("query_id", file_paths(F.col("text")).alias("__mentioned"))
    out = rows.join(asked, "query_id", "left").withColumn("score", F.round(path_boost(F.col("score"), F.col("file_path"), F.col("__mentioned"), boost), 8))
    return reranked(out.drop("__mentioned", "rank"))


def test_penalty(score: Column, path: Column, penalty: float = 0.85, patterns: list[str] | None = None) -> Column:
    if penalty <= 0:
        return score
    return F.when(paths.is_test_file(path) | paths.matches_penalty_paths(path, patterns or []), score * (1 - min(penalty, 1.0))).otherwise(score)


def noncode_penalty(score: Column, path: Column, penalty: float = 0.8) -> Column:
    return score if penalty <= 0 else F.when(paths.is_noncode_file(path), score * (1 - min(penalty, 1.0))).otherwise(score)


def fixture_penalty(score: Column, path: Column) -> Column:
    return F.when(paths.is_test_fixture(path), score * 0.05).otherwise(score)


def source_neighbors(rows: DataFrame, nodes: DataFrame, factor: float = 1.5) -> DataFrame:
    """Boosts, or injects, nodes of the source files that ranked test files point to, by factor times the test's score."""
    tests = rows.where(paths.is_test_file(F.col("file_path"))).select("query_id", "score", F.explode(paths.source_candidates(F.col("file_path"))).alias("file_path"))
    boost = tests.groupBy("query_id", "file_path").agg(F.max(F.col("score") * factor).alias("boost"))
    target = boost.join(nodes.select("node_id", "file_path"), "file_path").select("query_id", "node_id", "boost")
    out = rows.select("query_id", "node_id", "score").join(target, ["query_id", "node_id"], "full_outer")
    return reranked(out.select("query_id", "node_id", F.round(F.coalesce("score", F.lit(0.0)) + F.coalesce("boost", F.lit(0.0)), 6).alias("score")))


def directory_cohesion(rows: DataFrame, top: int = 5, boost: float = 0.01) -> DataFrame:
    """rows(file_path, ...): those below the top that share a folder with one of it get boost."""
    rows = rows.withColumn("folder", F.regexp_replace("file_path", "/?[^/]*$", ""))
    heads = rows.where(F.col("rank") <= top).select("query_id", "folder").distinct().withColumn("shared", F.lit(True))
    rows = rows.join(heads, ["query_id", "folder"], "left")
    return reranked(rows.select("query_id", "node_id", F.round(F.col("score") + F.when((F.col("rank") > top) & F.col("shared"), boost).otherwise(0.0), 6).alias("score")))


def rank_pipeline(rows: DataFrame, nodes: DataFrame, queries: DataFrame | None = None, penalty: float = 0.85, anchors: int | None = 5, penalty_paths: list[str] | None = None) -> DataFrame:
    """From fused rows to anchors: documentation out, literal boost, boost of mentioned paths, tests and fixtures penalised.

    Literal matches may bring documentation back. nodes: node_id, file_path, and for queries(query_id, text) name, signature, doc_comment, text.
    """
    rows = drop_noncode(with_nodes(rows, nodes, "file_path"))
    if queries is not None:
        rows = with_nodes(literal_boost(reranked(rows.drop("rank")), nodes, queries), nodes, "file_path")
        rows = boosted_by_paths(rows, queries)
    path = F.col("file_path")
    score = fixture_penalty(test_penalty(F.col("score"), path, penalty, penalty_paths), path)
    out = reranked(rows.select("query_id", "node_id", "file_path", F.round(score, 8).alias("score")))
    return out if anchors is None else out.where(F.col("rank") <= anchors)
