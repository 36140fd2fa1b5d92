"""Toxicity by weak supervision.

1. Voters. Words and word stems whose documents are far more often toxic than others are mined
   from training labels; those that a mined stem begins are one lexicon voter with it. Pattern voters look at their density, variety,
   disguised spelling and absence.
2. Label model. A generative model has a class prior and, per voter, its firing rate in either
   class; EM estimates them over the votes of all documents, labelled or not, starting from and
   held by the labelled counts. Voters' correlations inside the classes, estimated from the same
   posteriors, discount the evidence of voters that repeat each other.
3. Classifier. A logistic regression over counts, densities and patterns is trained on the posterior labels of the labelled sample;
   its probability is the score of every whole text.

Each text is read once: its counts are stored, few as they are. Documents with equal votes are one row with their number from
then on, and a round of EM is a sum over those rows on the executors; the driver holds only what grows with the voters.
Mining and the classifier use at most SAMPLE labelled rows, those with the lowest hash of their id.

Defined cases: a null text is the empty text and is scored; labels with null doc_id or label are
ignored; without toxic or without other training rows, all scores are the share of label 1 (0
without any); repeated rows get equal scores; a text of any length is read whole; an empty table gives no rows. Other columns of the input,
whatever their names, are not read; filter_toxic keeps them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import given_back, stored, table

SAMPLE = 40_000
#: Lexicon voters at most, and terms that they are made of, the surest first: they bound the model, which is quadratic in voters.
VOTERS, TERMS = 256, 4096
STEMS = (5, 6, 7)
LEAST_DOCS = 4
LEAST_LOG_ODDS = 3.5
LEAST_SURE = 3.0
THRESHOLD = 0.5
PATTERNS = ("two_terms", "dense", "varied", "disguised", "loud", "none")
_CUT = re.compile(r"[\W_]+")
_MIXED = re.compile(r"[^\W\d_][0134578@$]+[^\W\d_]")
_PLAIN = str.maketrans("0134578@$", "oieastbas")


def normal(text: str) -> str:
    """Lower-cased words with one space around each."""
    return f" {_CUT.sub(' ', text.lower()).strip()} "


def terms_of(text: str) -> set[str]:
    """The distinct words (" word ") and stems (" stem") of a text, as they are searched for."""
    words = set(normal(text).split())
    out = {f" {w} " for w in words if len(w) > 2}
    for k in STEMS:
        out |= {f" {w[:k]}" for w in words if len(w) > k}
    return out


@dataclass
class Finder:
    """Counts of each voter in a text, and the pattern voters. A voter is a list of terms; it counts as often as the most frequent of them."""

    voters: list[list[str]]

    def __post_init__(self) -> None:
        self.search = None

    def __getstate__(self) -> dict:
        return {"voters": self.voters}

    def __setstate__(self, state: dict) -> None:
        self.voters, self.search = state["voters"], None

    @property
    def width(self) -> int:
        return len(self.voters) + len(PATTERNS) + 2

    def counts(self, text: str) -> dict[int, int]:
        """Count by voter."""
        if not self.voters:
            return {}
        if self.search is None:
            import ahocorasick

            self.search = ahocorasick.Automaton()
            for i, terms in enumerate(self.voters):
                for t in terms:
                    self.search.add_word(t, (i, t))
            self.search.make_automaton()
        out: dict[int, int] = {}
        for (i, _), n in Counter(x for _, x in self.search.iter(text)).items():
            out[i] = max(out.get(i, 0), n)
        return out

    def features(self, text: str) -> tuple[list[int], list[float]]:
        """Places and values other than 0 of: counts of the voters, whether each pattern fires, words, hits per thousand words."""
        own = normal(text)
        words = own.count(" ") - 1 if len(own) > 2 else 0
        c = self.counts(own)
        hits, kinds = sum(c.values()), len(c)
        disguised = bool(self.voters) and _MIXED.search(text) is not None and sum(self.counts(normal(text.lower().translate(_PLAIN))).values()) > hits
        rate = 1000 * hits / max(words, 1)
        loud = hits > 0 and text.count("!") * 50 > words
        rest = [hits >= 2, rate >= 4, kinds >= 2, disguised, loud, hits == 0, words, rate]
        found = [*sorted(c.items()), *((len(self.voters) + i, x) for i, x in enumerate(rest) if x)]
        return [i for i, _ in found], [float(x) for _, x in found]


def dense(at: pa.Array, values: pa.Array, width: int) -> np.ndarray:
    """Rows of Finder.features as a matrix."""
    sizes = np.diff(at.offsets.to_numpy())
    out = np.zeros((len(at), width), np.float32)
    out[np.repeat(np.arange(len(at)), sizes), at.flatten().to_numpy(zero_copy_only=False)] = values.flatten().to_numpy(zero_copy_only=False)
    return out


def rank_of(key: Column) -> Column:
    """A number in [0, 1) from an id, the same on every run."""
    return F.pmod(F.xxhash64(F.lit(8), key), F.lit(1 << 30)) / F.lit(float(1 << 30))


def bounded(rows: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """About the n rows with the lowest hash of their id, or all."""
    total = rows.count()
    return rows if total <= n else rows.where(rank_of(F.col(key)) < n / total)


def without_copies(rows: DataFrame) -> DataFrame:
    """rows(text, y) with one of those that share the least hash of their 3-word shingles.

    Copies and near copies of a document would otherwise make its rare words look like evidence.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for b in batches:
            least = []
            for t in b.column(0).to_pylist():
                w = normal(t).split()
                least.append(min((xxh3_64_intdigest(" ".join(w[i : i + 3])) >> 1 for i in range(max(1, len(w) - 2))), default=0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(least, pa.int64())], names=["text", "y", "least"])

    return rows.select("text", "y").mapInArrow(given_back(run), "text string, y int, least long").dropDuplicates(["least", "y"]).select("text", "y")


def mined(rows: DataFrame) -> list[list[str]]:
    """Voters from rows(text, y): terms by log odds of their documents being toxic, with a mined stem those that it begins, at most VOTERS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = Counter(), Counter()
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found[y].update(terms_of(t))
            keys = list(found[0].keys() | found[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([found[1][k] for k in keys], pa.int64()), pa.array([found[0][k] for k in keys], pa.int64())], names=["term", "bad", "good"])

    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return []
    c = rows.select("text", "y").mapInArrow(given_back(run), "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (n[1] + 1.0)) - F.log((F.col("good") + 0.5) / (n[0] + 1.0))
    # a term counts by how sure its odds are: less one standard error of the log odds
    sure = odds - F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    c = c.where(F.col("bad") >= F.lit(max(LEAST_DOCS, 0.005 * n[1]))).withColumn("sure", sure).where((odds >= LEAST_LOG_ODDS) & (F.col("sure") >= LEAST_SURE))
    sure = {r.term: r.sure for r in c.select("term", "sure").orderBy(F.desc("sure"), "term").limit(TERMS).collect()}
    voters: dict[str, list[str]] = {}
    for t in sorted(sure, key=lambda t: (len(t), t)):
        stem = next((t[: k + 1] for k in STEMS if t[: k + 1] in voters), t)
        voters.setdefault(stem, []).append(t)
    return sorted(voters.values(), key=lambda ts: (-max(sure[t] for t in ts), ts))[:VOTERS]


def blocks(n: int, size: int = 4096) -> list[slice]:
    """Slices of n rows, so that temporaries stay small beside the driver's heap."""
    return [slice(k, k + size) for k in range(0, max(n, 1), size)]


@dataclass
class LabelModel:
    prior: float
    rates: np.ndarray  # voters x classes
    weights: np.ndarray  # discount of each voter's evidence
    correlations: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        on = np.log(self.rates[:, 1] / self.rates[:, 0])
        off = np.log((1 - self.rates[:, 1]) / (1 - self.rates[:, 0]))
        log = np.log(self.prior / (1 - self.prior)) + off @ self.weights + np.concatenate([votes[k] @ ((on - off) * self.weights) for k in blocks(len(votes))])
        return 1 / (1 + np.exp(-np.clip(log, -40, 40)))


def vote_sums(votes: np.ndarray, counts: np.ndarray, model: LabelModel | None) -> np.ndarray:
    """What a round of EM adds up over rows of equal votes, as one vector; counts are of unlabelled, clean and toxic documents.

    Labelled rows keep their label at half weight against their posterior, so that the classes stay what the labels mean and
    label noise can be overruled. The first round (no model) has labelled rows alone.
    """
    v = votes.shape[1]
    total = np.zeros(2 + 2 * v + v * v)
    for k in blocks(len(votes)):
        x = votes[k].astype(float)
        p = model.posterior(x) if model else np.zeros(len(x))
        for kind, q in enumerate((p, 0.5 * p, 0.5 + 0.5 * p) if model else (p, p, p + 1)):
            w = counts[k, kind] * (1.0 if model or kind else 0.0)
            if not w.any():
                continue
            on = w * q
            total[0] += on.sum()
            total[1] += w.sum() - on.sum()
            total[2 : 2 + v] += on @ x
            total[2 + v : 2 + 2 * v] += (w - on) @ x
            if model:
                left = x - (q[:, None] * model.rates[:, 1] + (1 - q[:, None]) * model.rates[:, 0])
                total[2 + 2 * v :] += ((left * w[:, None]).T @ left).ravel()
    return total


def updated(total: np.ndarray, v: int, first: bool) -> LabelModel:
    n1, n0 = total[:2]
    fired = np.stack([total[2 + v : 2 + 2 * v], total[2 : 2 + v]], 1)
    rates = np.clip((fired + [0.2, 0.5]) / [n0 + 20, n1 + 2], 1e-5, 1 - 1e-5)
    # correlations between voters once the class is known
    corr = np.zeros((v, v))
    if not first:
        cov = total[2 + 2 * v :].reshape(v, v) / (n1 + n0)
        sd = np.sqrt(np.diag(cov)) + 1e-9
        corr = cov / np.outer(sd, sd)
        np.fill_diagonal(corr, 0)
    tied = np.where(np.abs(corr) > 0.15, np.abs(corr), 0)
    return LabelModel(float(np.clip(n1 / (n1 + n0), 1e-4, 1 - 1e-4)), rates, 1 / (1 + tied.sum(1)), corr)


def label_model(sums: Callable[[LabelModel | None], np.ndarray], v: int, rounds: int = 12) -> LabelModel:
    """EM: sums(model) gives vote_sums over all rows."""
    model = updated(sums(None), v, True)
    for _ in range(rounds):
        old, model = model, updated(sums(model), v, False)
        if np.abs(np.log(model.rates / old.rates)).max() < 0.01 and np.abs(model.weights - old.weights).max() < 0.01:
            break
    return model


@dataclass
class Linear:
    shift: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = (np.log1p(x) - self.shift) / self.scale
        return 1 / (1 + np.exp(-np.clip(z @ self.weights[1:] + self.weights[0], -40, 40)))


def train(x: np.ndarray, p: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> Linear:
    """Logistic regression on soft labels p by Newton steps."""
    n, sums, squares = len(x), 0.0, 0.0
    for k in blocks(n):
        logs = np.log1p(x[k].astype(float))
        sums, squares = sums + logs.sum(0), squares + (logs**2).sum(0)
    shift = sums / n
    scale = np.sqrt(np.maximum(squares / n - shift**2, 0))
    scale[scale < 1e-6] = 1
    w = np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        grad, hess = ridge * np.r_[0, w[1:]], ridge * np.eye(len(w))
        for k in blocks(n):
            z = np.hstack([np.ones((len(x[k]), 1)), (np.log1p(x[k].astype(float)) - shift) / scale])
            m = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            grad = grad + z.T @ (m - p[k])
            hess = hess + (z * (m * (1 - m))[:, None]).T @ z
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return Linear(shift, scale, w)


@dataclass
class Model:
    finder: Finder
    labels: LabelModel | None
    linear: Linear


def featured(rows: DataFrame, finder: Finder, *keys: str) -> DataFrame:
    """keys, at, n: features of rows(text, keys), without those that are 0."""
    schema = ", ".join([*(f"{c} {t}" for c, t in rows.select(*keys).dtypes), "at array<int>", "n array<float>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [finder.features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([x for x, _ in found], pa.list_(pa.int32())), pa.array([x for _, x in found], pa.list_(pa.float32()))], names=[*keys, "at", "n"])

    return rows.select("text", *keys).mapInArrow(given_back(run), schema)


def summed(patterns: DataFrame, v: int) -> Callable[[LabelModel | None], np.ndarray]:
    """vote_sums over patterns(votes, n, n0, n1), votes being the places of the voters that fire."""

    def sums(model: LabelModel | None) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 + 2 * v + v * v)
            for b in batches:
                for k in range(0, b.num_rows, 8192):
                    part = b.slice(k, 8192)
                    at = part.column(0)
                    votes = dense(at, pa.ListArray.from_arrays(at.offsets, pa.array(np.ones(len(at.values), np.float32))), v)
                    total += vote_sums(votes, np.stack([c.to_numpy() for c in part.columns[1:]], 1), model)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["i", "v"])

        rows = patterns.select("votes", "n", "n0", "n1").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow().combine_chunks()
        out = np.zeros(2 + 2 * v + v * v)
        out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
        return out

    return sums


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> tuple[Model, DataFrame | None]:
    """(model, features of all docs) from docs(doc_id, text) and the training rows labels(doc_id, label)."""
    y = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col(label).cast("int").alias("y")).where(F.col("__id").isNotNull() & F.col("y").isin(0, 1))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    chosen = stored(bounded(y, SAMPLE, "__id"), "toxicity-labels")
    own = stored(rows.join(chosen, rows.doc_id == chosen["__id"]).select("text", "y"), "toxicity-training")
    share = own.agg(F.avg("y")).first()[0]
    if share in (None, 0.0, 1.0):
        return Model(Finder([]), None, Linear(np.zeros(0), np.ones(0), np.zeros(1), float(share or 0.0))), None
    finder = Finder(mined(stored(without_copies(own), "toxicity-mining")))
    every, training = stored(featured(rows, finder, "doc_id"), "toxicity-features"), stored(featured(own, finder, "y"), "toxicity-training-features")
    v = finder.width - 2
    votes = F.filter("at", lambda i: i < v).alias("votes")
    counts = every.select(votes, F.lit(1).alias("n"), F.lit(0).alias("n0"), F.lit(0).alias("n1"))
    # the labelled rows are among all rows, as unlabelled ones: they come off there
    counts = counts.union(training.select(votes, F.lit(-1), 1 - F.col("y"), F.col("y")))
    patterns = stored(counts.groupBy("votes").agg(*[F.sum(c).alias(c) for c in ("n", "n0", "n1")]), "toxicity-votes")
    model = label_model(summed(patterns, v), v)
    got = training.select("at", "n").toArrow().combine_chunks()
    x = np.concatenate([dense(b.column(0), b.column(1), finder.width) for b in got.to_batches()])
    p = np.concatenate([model.posterior((x[k, :v] > 0).astype(float)) for k in blocks(len(x))])
    return Model(finder, model, train(x, p)), every


def scored(features: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for every row of features(doc_id, at, n)."""
    linear, width = model.linear, model.finder.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(linear.score(dense(b.column(1), b.column(2), width)))], names=["doc_id", "score"])

    return features.mapInArrow(run, "doc_id long, score double")


def held_out(key: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def filter_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores below the threshold; the text is scored in place, row by row."""
    model, _ = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    finder, linear = model.finder, model.linear
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [finder.features(t or "") for t in b.column(at).to_pylist()]
            x = dense(pa.array([x for x, _ in found], pa.list_(pa.int32())), pa.array([x for _, x in found], pa.list_(pa.float32())), finder.width)
            yield b.filter(pa.array(linear.score(x) < threshold))

    return docs.mapInArrow(given_back(run), docs.schema)


def op8_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, features = fit(docs, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    if features is None:
        out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(model.linear.constant).alias("score"))
    else:
        out = scored(features, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
