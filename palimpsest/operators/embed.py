"""Vectors of texts: a pluggable encoder in batches of texts of like length, and a hashed one that needs no model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], np.ndarray]


def hashed(dim: int) -> Encoder:
    """Words and their runs of three letters, each a signed place of the vector by its hash; unit length, zero for no words."""

    def encode(texts: list[str]) -> np.ndarray:
        import re
        import zlib

        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                for x in (w, *(f"#{w[k : k + 3]}" for k in range(len(w) - 2))):
                    h = zlib.crc32(x.encode())
                    out[i, h % dim] += 1 if h >> 31 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    return encode


def embedded(texts: DataFrame, encode: Encoder, batch: int = 256) -> DataFrame:
    """node_id, vector of texts(node_id, text). Texts are dealt and sorted by length, so a batch is padded little and batches of any length are spread over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, batch):
                part = b.slice(k, batch)
                made = encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(made.astype(np.float32)), pa.list_(pa.float32()))], names=["node_id", "vector"])

    length = F.length(F.coalesce("text", F.lit("")))
    rows = texts.select("node_id", "text", length.alias("n")).repartitionByRange("n", "node_id").sortWithinPartitions("n", "node_id")
    return rows.select("node_id", "text").mapInArrow(run, "node_id string, vector array<float>")


def hash_of(text: Column) -> Column:
    """What a text's vector is kept under."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def missing(texts: DataFrame, known: DataFrame | None, encode: Encoder, batch: int = 256) -> DataFrame:
    """text_hash, vector of those of texts(node_id, text) that known(text_hash, vector) doesn't have; equal texts are encoded once."""
    rows = texts.select(hash_of(F.col("text")).alias("node_id"), "text").dropDuplicates(["node_id"])
    if known is not None:
        rows = rows.join(known.select(F.col("text_hash").alias("node_id")), "node_id", "left_anti")
    return embedded(rows, encode, batch).select(F.col("node_id").alias("text_hash"), "vector")
