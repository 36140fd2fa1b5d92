"""Language of texts by a string kernel: presence of blended n-grams, Nyström landmarks, one-versus-rest kernel ridge regression.

A text has the set G of its distinct n-grams of 1 to LONGEST bytes, taken from its lower-cased words with one space around each
(whatever in ASCII is no letter counts as a space). The kernel of two texts is |G(x) & G(y) & U| / sqrt(|G(x) & U| |G(y) & U|), where the
universe U is the n-grams that two landmarks or more have. Landmarks are sampled texts, the same number of each language; K is their kernel
matrix, and a text's Nyström features are its kernel values to them times K^(-1/2). Per language a ridge regression
of +1 and -1 is solved from sums over the sampled texts, which tasks make and the driver only adds up.

Scoring is a product of a batch's presence matrix with landmarks' presence and the regression's weights. Products may be taken in any order, so
those of landmarks and weights are taken once, and a text costs a product with one column per language.

The fit reads a bounded sample (`sample` rows, as many of each language as there are, chosen by a hash of id and text); counts of languages and
predictions are over all documents, and no text is shuffled but the sample's.

Defined cases: the language of a null text and of one without a letter is `und`, with score 0, and such texts are learned from like
others; rows with null lang and held-out rows are never learned from; with nothing to learn from all is `und`; equal texts have
equal predictions; ties go to the first language by name; a null doc_id counts as empty text where its crc32 is taken; a text of any length is
read a megabyte at a time; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import given_back, stored, table
from .periodic_runs import GAP
from .quality_qda import held_out

LONGEST = 4
UNKNOWN = "und"
#: Bounds of what the model is fitted on: expected rows of the sample, landmarks, n-grams of the universe (the most shared ones), languages (the most frequent).
SAMPLE, LANDMARKS, UNIVERSE, LANGUAGES = 2000, 256, 200_000, 200
RIDGE = 1.0
#: ASCII but letters become spaces; bytes of other characters stay.
LETTERS = bytes(x if x >= 128 or chr(x).isalpha() else 32 for x in range(256))
#: Bytes of a text that are read at once, and up to the next white space.
PART = 1 << 20


def grams(text: bytes) -> np.ndarray:
    """The distinct n-grams of a UTF-8 text as sorted numbers: their bytes, which are never zero, so lengths can't be confused."""
    found, at, last = [], 0, []
    while at < len(text):
        gap = GAP.search(text, at + PART)
        end = gap.start() if gap else len(text)
        words = last + text[at:end].decode().lower().encode().translate(LETTERS).split()
        at = end
        if words == last:
            continue
        v = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
        codes, own, last = v, [v], words[-1:]
        for n in range(1, LONGEST):
            codes = (codes[:-1] << np.uint32(8)) | v[n:]
            own.append(codes)
        own = np.sort(np.concatenate(own))
        found.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
    if len(found) > 1:
        return np.unique(np.concatenate(found))
    return found[0] if found else np.empty(0, np.uint32)


def presence(universe: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    """A row per text: which n-grams of the universe it has."""
    out = np.zeros((len(texts), len(universe)), np.float32)
    for row, g in zip(out, texts, strict=True):
        at = np.searchsorted(universe, g)
        at[at == len(universe)] = 0
        row[at[universe[at] == g] if len(universe) else []] = 1
    return out


def inverse_norms(x: np.ndarray) -> np.ndarray:
    """1 / sqrt of each row's number of n-grams; 0 for none."""
    n = x.sum(1)
    return np.where(n > 0, 1 / np.sqrt(np.maximum(n, 1)), 0)


@dataclass
class Landmarks:
    """The universe, the landmarks' presence (packed bits) and K^(-1/2)."""

    universe: np.ndarray
    bits: np.ndarray
    root: np.ndarray

    @classmethod
    def of(cls, texts: list[np.ndarray], most: int = UNIVERSE) -> Landmarks:
        found, n = np.unique(np.concatenate(texts), return_counts=True) if texts else (np.empty(0, np.uint32), np.empty(0, int))
        shared = np.flatnonzero(n >= min(2, len(texts)))
        universe = np.sort(found[shared[np.lexsort((found[shared], -n[shared]))[:most]]])
        x = presence(universe, texts)
        k = x * inverse_norms(x)[:, None]
        values, vectors = np.linalg.eigh((k @ k.T).astype(np.float64))
        kept = values > 1e-6 * max(values.max(initial=0), 1e-12)
        return cls(universe, np.packbits(x.astype(bool), axis=1), vectors[:, kept] / np.sqrt(values[kept]))

    def matrix(self) -> np.ndarray:
        """Landmarks by n-grams, each row of length 1."""
        x = np.unpackbits(self.bits, axis=1, count=len(self.universe)).astype(np.float32)
        return x * inverse_norms(x)[:, None].astype(np.float32)

    def features(self, texts: list[np.ndarray], matrix: np.ndarray) -> np.ndarray:
        """Nyström features and a constant."""
        x = presence(self.universe, texts)
        k = (x @ matrix.T) * inverse_norms(x)[:, None]
        return np.hstack([k @ self.root, np.ones((len(texts), 1))])


@dataclass
class Model:
    languages: list[str]
    universe: np.ndarray
    weights: np.ndarray
    constants: np.ndarray

    def values(self, texts: list[np.ndarray]) -> np.ndarray:
        """The regressions' values, a column per language."""
        x = presence(self.universe, texts)
        return (x @ self.weights) * inverse_norms(x)[:, None] + self.constants


def _grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([grams(t.as_py()).astype(np.int64) for t in b.column(2)], pa.list_(pa.int64()))], names=["lang", "key", "grams"])


def sampled(rows: DataFrame, sample: int = SAMPLE, languages: int = LANGUAGES) -> tuple[list[str], DataFrame]:
    """The languages of rows(lang, doc_id, text), and lang, key, grams of about as many rows of each."""
    spark = rows.sparkSession
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    names = sorted(r.lang for r in counts)
    each = -(-sample // max(1, len(names)))
    rates = spark.createDataFrame([(r.lang, min(1.0, each / r.n)) for r in counts], "lang string, rate double")
    key = F.xxhash64("doc_id", "text")
    part = rows.select("lang", key.alias("key"), "text").join(F.broadcast(rates), "lang").where(F.shiftrightunsigned("key", 11) / float(1 << 53) < F.col("rate"))
    part = part.dropDuplicates(["lang", "key"]).select("lang", "key", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return names, stored(part.mapInArrow(given_back(_grams_of), "lang string, key long, grams array<long>"), "language-sample")


def fit(rows: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """A model of rows(doc_id, text, lang); rows without lang are left out."""
    names, part = sampled(rows.where("lang IS NOT NULL"), sample)
    turn = F.row_number().over(W.partitionBy("lang").orderBy("key"))
    chosen = part.select("lang", "key", turn.alias("turn")).orderBy("turn", "lang").limit(landmarks).select("lang", "key")
    texts = [np.array(r.grams, np.uint32) for r in part.join(F.broadcast(chosen), ["lang", "key"]).orderBy("lang", "key").select("grams").collect()]
    marks, c = Landmarks.of(texts), len(names)
    d, place = marks.root.shape[1] + 1, {x: k for k, x in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, total = marks.matrix(), np.zeros((d, d + c))
        for b in batches:
            for k in range(0, b.num_rows, 64):
                own = b.slice(k, 64)
                x = marks.features([np.array(g.values.to_numpy(zero_copy_only=False), np.uint32) for g in own.column(1)], matrix)
                y = np.full((len(x), c), -1.0)
                y[np.arange(len(x)), [place[v] for v in own.column(0).to_pylist()]] = 1
                total += x.T @ np.hstack([x, y])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "v"])

    sums = np.zeros(d * (d + c))
    for r in part.select("lang", "grams").mapInArrow(given_back(run), "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        sums[r.i] = r.v
    sums = sums.reshape(d, d + c)
    shrink = ridge * np.eye(d)
    shrink[-1, -1] = 1e-9
    solved = np.linalg.solve(sums[:, :d] + shrink, sums[:, d:])
    # text . landmarks, then . K^(-1/2), then . regressions: the last two products are the same for all texts
    return Model(names, marks.universe, (marks.matrix().T @ (marks.root @ solved[:-1])).astype(np.float32), solved[-1])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 64):
                own = b.slice(k, 64)
                known = own.column(2).to_numpy(zero_copy_only=False).astype(bool) & bool(model.languages)
                names, score = np.full(len(known), UNKNOWN, object), np.zeros(len(known))
                if known.any():
                    values = model.values([grams(t.as_py()) for t, y in zip(own.column(1), known, strict=True) if y])
                    best = values.argmax(1)
                    names[known] = np.array(model.languages, object)[best]
                    score[known] = np.clip((1 + values[np.arange(len(best)), best]) / 2, 0, 1)
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    text: Column = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text"), text.rlike(r"\p{L}").alias("letters"))
    return rows.mapInArrow(given_back(run), "doc_id long, lang_pred string, score double")


def op13_language_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"), 4, 2)).select("doc_id", "text", "lang"))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
