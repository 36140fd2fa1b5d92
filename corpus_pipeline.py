"""A corpus from documents: stages of the llm operators, each over all that its predecessor kept.

Defined cases: a null text is an empty one, which is kept unless another empty one is (near-dedup) and is in the mix as whole copies;
null and repeated ids are told apart by text; null sources are a source; empty tables give no rows; other columns of documents
stay, but for shard and slot, which the last stage's replace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import decontaminate, mixing, sharding, simhash, toxicity
from palimpsest.llm.common import MADE, released, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject."""
    return toxicity.filter_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, at a distance that near copies with some edits are within too."""
    return simhash.dedupe(docs, distance=4)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot."""
    return sharding.shard(docs, 24)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", to_shards),
]

#: The toxicity classifier and XXH64 fingerprints can't be said in SQL; tests/llm hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), len(MADE)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        released(spark, before)  # the stage before and this one's own tables
    return STAGES[-1][1](spark, docs, sf_dir)
