"""Incremental ingest with Structured Streaming: deduplicated events, windows, bursts of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)


def stream_of(spark: SparkSession, table: str, schema) -> DataFrame:
    """A stream of a Parquet table that is one file or a folder of them: as a pattern its path may be either."""
    return read_stream(spark, f"{table[:-1]}[{table[-1]}]", schema)


def deduplicated(events: DataFrame, *keys: str) -> DataFrame:
    """The first event of each key, for the stream's lifetime."""
    return events.dropDuplicates(list(keys))


def windowed(events: DataFrame, ts: str, length: str, late: str, *by: str) -> DataFrame:
    """Counts and sums of value per window of event time; events later than `late` don't count."""
    per = events.withWatermark(ts, late).groupBy(F.window(ts, length), *by)
    return per.agg(F.count("*").alias("n"), F.sum("value").alias("v")).select(F.col("window.start").alias("start"), *by, "n", "v")


def bursts(changes: DataFrame, ts: str, gap: str, *by: str) -> DataFrame:
    """Bursts of changes closer than gap, with their distinct paths: a debounced trigger."""
    return changes.groupBy(F.session_window(ts, gap), *by).agg(F.count("*").alias("n"), F.sort_array(F.collect_set("path")).alias("paths"))


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that is there now, exactly once, into Parquet under path; offsets stay in the checkpoint."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    q.awaitTermination()


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, outcome from manifests (path, file_hash): unchanged, changed, added, deleted."""
    rows = old.select("path", F.col("file_hash").alias("h0")).join(new.select("path", F.col("file_hash").alias("h1")), "path", "full_outer")
    outcome = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "deleted").when(F.col("h0") == F.col("h1"), "unchanged").otherwise("changed")
    return rows.select("path", outcome.alias("outcome"))


def outcomes(old: DataFrame, new: DataFrame, parsed: DataFrame) -> DataFrame:
    """path, outcome, file_hash: manifest_diff with what parsing (parsed: path, ok) made of the files that were to be parsed.

    Files no parser takes are skipped; where parsing failed, the old entry's hash is carried, so that the next run tries again.
    """
    rows = manifest_diff(old, new).join(parsed.select("path", "ok"), "path", "left")
    rows = rows.join(old.select("path", F.col("file_hash").alias("h0")), "path", "left").join(new.select("path", F.col("file_hash").alias("h1")), "path", "left")
    todo = F.col("outcome").isin("added", "changed")
    outcome = F.when(~todo, F.col("outcome")).when(F.col("ok").isNull(), "skipped").when(F.col("ok"), "parsed").otherwise("parse_failed")
    return rows.select("path", outcome.alias("outcome"), F.when(outcome == "parse_failed", F.col("h0")).otherwise(F.coalesce("h1", "h0")).alias("file_hash"))


def stats(outcome: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: files by outcome, nodes, and files with nodes by language."""
    from ..functions.paths import language_name

    kinds = ("added", "changed", "unchanged", "deleted", "parsed", "skipped", "parse_failed")
    files = outcome.agg(*[F.count_if(F.col("outcome") == k).alias(k) for k in kinds])
    langs = nodes.groupBy(language_name(F.col("file_path")).alias("language")).agg(F.count_distinct("file_path").alias("files"), F.count("*").alias("nodes"))
    langs = langs.agg(F.coalesce(F.sum("nodes"), F.lit(0)).alias("nodes"), F.sort_array(F.collect_list(F.struct("language", "files"))).alias("languages"))
    return files.join(langs)  # one row each


def expiring(events: DataFrame, ts: str, keep: str, *keys: str) -> DataFrame:
    """The first event of each key of a stream, told apart for `keep` of event time; state older than that is dropped."""
    return events.withWatermark(ts, keep).dropDuplicatesWithinWatermark(list(keys))


def is_stale(manifest: DataFrame, files: DataFrame) -> bool:
    """Whether a file is newer than the manifest, or one of the two lacks a path, or the manifest is empty."""
    rows = manifest.select("path", "indexed").join(files.select(F.col("file_path").alias("path"), "modified"), "path", "full_outer")
    old = rows.where(F.col("indexed").isNull() | F.col("modified").isNull() | (F.col("modified") > F.col("indexed")))
    return manifest.isEmpty() or not old.isEmpty()


def carried(old_nodes: DataFrame, new_nodes: DataFrame, stale: DataFrame) -> DataFrame:
    """new_nodes with those of old_nodes that are neither replaced nor stale."""
    keep = old_nodes.join(new_nodes.select("node_id"), "node_id", "left_anti").join(stale.select("node_id"), "node_id", "left_anti")
    return keep.unionByName(new_nodes)


def sessions(events: DataFrame, by: str, ts: str, gap_seconds: int) -> DataFrame:
    """by, session, n, first, last: events of one key without a gap of gap_seconds or more (a batch, by lag and running sum)."""
    order = W.partitionBy(by).orderBy(ts)
    apart = F.unix_seconds(ts) - F.unix_seconds(F.lag(ts).over(order)) >= gap_seconds
    rows = events.withColumn("session", F.sum(F.when(apart, 1).otherwise(0)).over(order.rangeBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(by, "session").agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))
