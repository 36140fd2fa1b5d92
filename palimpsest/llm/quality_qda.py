"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each whole text gives the statistics of NAMES, transformed to be roughly normal. Per class the
mean and covariance come from distributed sums over all training rows; a class covariance is shrunk
towards the pooled one and then to its own mean variance, so that it is well conditioned with few rows.
The model is the two means, the Cholesky factors of the covariances and their log determinants,
factored once; a score is the logistic of the log-density difference of the classes plus the log
odds of the classes, divided by a temperature that allows for the statistics' dependence.

Defined cases: a null text is the empty text and is scored; labels with null doc_id or label are
ignored, repeated labels count as rows; with no training row of a class all scores are the share
of label 1 (0.5 without any); an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import given_back, stored, table

NAMES = ("words", "word_len", "word_len_sd", "upper", "digit", "mark", "symbol", "shout", "foreign", "lines", "distinct", "triples", "top", "same_next", "dup_lines", "first_upper", "ends")
THRESHOLD = 0.7
LIST = pa.list_(pa.float64())


def _logit(x: float, n: float) -> float:
    """Log odds of x out of n, drawn to the middle by one part in 200."""
    p = (x + 0.005 * n + 0.005) / (1.01 * n + 0.01)
    return float(np.log(p / (1 - p)))


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of a UTF-8 text; one pass over its bytes and one over its words."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    of = lambda chars: int(counts[list(chars)].sum())
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    w = text.split()
    n = len(w)
    visible = len(text) - of(b" \t\n\x0b\x0c\r")
    lens = np.fromiter(map(len, w), np.float64, n) if n else np.zeros(1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    common = Counter(w)
    triples = len(set(zip(w, w[1:], w[2:], strict=False)))
    caps = sum(x[:1].isupper() for x in w)
    return [
        float(np.log1p(n)),
        float(np.log1p(lens.mean())),
        float(np.log1p(lens.std())),
        _logit(upper, upper + lower),
        _logit(of(b"0123456789"), visible),
        _logit(of(b".,;:?'\"()-"), visible),
        _logit(of(b"#*$%&|<>@^~_=+[]{}\\/`"), visible),
        _logit(of(b"!"), visible),
        _logit(int(counts[128:].sum()), visible),
        float(np.log1p(len(lines)) - np.log1p(n)),
        _logit(len(common), n),
        _logit(triples, max(n - 2, 0)),
        _logit(max(common.values(), default=0), n),
        _logit(sum(a == b for a, b in zip(w, w[1:], strict=False)), n),
        _logit(len(lines) - len(set(lines)), len(lines)),
        _logit(caps, n),
        _logit(sum(x[-1:] in b".!?" for x in w), n),
    ]


def featured(docs: DataFrame) -> DataFrame:
    """doc_id, x array<double> for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([statistics(t.as_py()) for t in b.column(1)], LIST)], names=["doc_id", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(given_back(run), "doc_id long, x array<double>")


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors (of the scaled statistics) and log determinants of both classes."""

    shift: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    logdets: list[float]
    log_odds: float
    temperature: float
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = (x - self.shift) / self.scale
        logs = [-0.5 * (((z - m) @ f.T) ** 2).sum(1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.logdets, strict=True)]
        return 1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) / self.temperature + self.log_odds, -50, 50)))


def sums(rows: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Per class (n, sum, sum of products), over all rows(x, y): partial sums per task, then per class."""
    d = len(NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            y = b.column(1).to_numpy(zero_copy_only=False)
            for k in (0, 1):
                own = np.hstack([np.ones(((y == k).sum(), 1)), x[y == k]])
                total[k] = total.get(k, 0) + own.T @ own
        for k, m in total.items():
            i = np.arange(m.size)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, k, np.int32)), pa.array(i.astype(np.int32)), pa.array(m.ravel())], names=["y", "i", "v"])

    parts = rows.select("x", F.col("y").cast("int").alias("y")).mapInArrow(run, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).collect()
    out = {}
    for k in (0, 1):
        m = np.zeros((d + 1) ** 2)
        for r in parts:
            if r.y == k:
                m[r.i] = r.v
        m = m.reshape(d + 1, d + 1)
        out[k] = (int(m[0, 0]), m[0, 1:], m[1:, 1:])
    return out


def fit(rows: DataFrame, to_pooled: float = 0.15, to_identity: float = 0.05, temperature: float = 2.0) -> Discriminant:
    """rows: x, y (0 or 1). to_pooled and to_identity are the shrinkage weights."""
    s = sums(rows)
    n = {k: s[k][0] for k in s}
    d, zero = len(NAMES), np.zeros(len(NAMES))
    if not n[0] or not n[1]:
        return Discriminant(zero, zero + 1, [], [], [], 0.0, 1.0, n[1] / (n[0] + n[1]) if n[0] + n[1] else 0.5)
    total = n[0] + n[1]
    shift = (s[0][1] + s[1][1]) / total
    scale = np.sqrt(np.maximum(np.diag(s[0][2] + s[1][2]) / total - shift**2, 1e-6))
    means, covs = [], []
    for k in (0, 1):
        m = s[k][1] / n[k]
        covs.append((s[k][2] / n[k] - np.outer(m, m)) / np.outer(scale, scale))
        means.append((m - shift) / scale)
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / total
    factors, logdets = [], []
    for c in covs:
        c = (1 - to_pooled) * c + to_pooled * pooled
        c = (1 - to_identity) * c + to_identity * (np.trace(c) / d + 1e-6) * np.eye(d)
        low = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(low))
        logdets.append(2 * float(np.log(np.diag(low)).sum()))
    return Discriminant(shift, scale, means, factors, logdets, float(np.log(n[1] / n[0])), temperature)


def scored(rows: DataFrame, model: Discriminant) -> DataFrame:
    """rows(doc_id, x) with their score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return rows.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def held_out(key, modulus: int, rest: int):
    """Whether crc32 of an id as text leaves this remainder; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == rest


def training(rows: DataFrame, labels: DataFrame, label: str, modulus: int, rest: int) -> DataFrame:
    """x, y: rows(doc_id, x) with a label, without the held-out ids."""
    y = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col("__id"), modulus, rest))
    return rows.join(y, rows.doc_id == y["__id"]).select("x", "y")


def op2_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(featured(table(spark, sf_dir, "documents")), "qda-statistics")
    model = fit(training(rows, table(spark, sf_dir, "labels"), "quality", 4, 2))
    return scored(rows, model).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


