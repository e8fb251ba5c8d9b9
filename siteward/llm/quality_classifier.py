"""Text quality from random-indexing word vectors, pooled for each document, and a two-layer network with calibrated scores.

Each word has an index vector, few of whose components are 1 or -1, drawn by its bucket; a word's vector is the sum of the index
vectors of what stands within WINDOW words of it, itself included, over all documents. Words share BUCKETS buckets by hash, so
that the table of vectors has a proven size whatever the corpus: tasks sum their own, sums of whole numbers are added up by
bucket, and the table goes to the tasks again. A document is the mean of its words' vectors with the shares of its words'
shapes and repeats. The network is fitted by numpy on a bounded sample of labelled documents; a part of the sample that it has
not seen sets the temperature that its logits are divided by, so that scores are probabilities.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteward.llm.common import table
from siteward.llm.token_alignment import pieces_of
from siteward.session import discard, materialize

#: The bound of the labelled sample.
TRAIN_DOCS = 8_000
#: The table of vectors has BUCKETS rows of DIMS floats: 8 MB. Index vectors have NONZERO components.
BUCKETS, DIMS, NONZERO, WINDOW = 65_536, 32, 2, 2
TOKEN = re.compile(r"\w+|[^\w\s]+")
SHAPES = ["lower", "capital", "upper", "digits", "mixed", "symbols"]
FEATURES = DIMS + len(SHAPES) + 3
CHUNK_CHARS, HIDDEN, STEPS, SEED = 500_000, 32, 400, 11


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's components."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, DIMS, (BUCKETS, NONZERO)), rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def shape(word: str) -> int:
    if not (word[0].isalnum() or word[0] == "_"):
        return 5
    if word.isdigit():
        return 3
    if word.islower():
        return 0
    if word.isupper() and len(word) > 1:
        return 2
    return 1 if word[0].isupper() and (len(word) == 1 or word[1:].islower()) else 4


class Words:
    """The words of some texts one behind the other: bucket, shape and text of each."""

    def __init__(self, texts: list[str | None]):
        found = [TOKEN.findall(t) if t else [] for t in texts]
        self.counts = np.array([*map(len, found)], np.int64)
        self.code, different = pd.factorize(np.array([w for words in found for w in words], object))
        bucket = np.array([zlib.crc32(w.lower().encode()) % BUCKETS for w in different], np.int64)
        self.bucket = bucket[self.code] if len(different) else self.code
        self.shape = np.array([*map(shape, different)], np.int64)[self.code] if len(different) else self.code
        self.text = np.repeat(np.arange(len(texts)), self.counts)

    def add_contexts(self, to: np.ndarray, place: np.ndarray, sign: np.ndarray) -> None:
        """Add to each word's row the index vectors of the words around it, and its own."""
        names, local, n = np.unique(self.bucket, return_inverse=True, return_counts=True)
        place, sign, every = place[names], sign[names], np.arange(len(local))
        at, of = [], []
        for step in range(1, WINDOW + 1):
            left = every[: len(every) - step]
            left = left[self.text[left] == self.text[left + step]]
            at += [local[left], local[left + step]]
            of += [local[left + step], local[left]]
        at.append(np.arange(len(names)))  # itself, as often as it comes
        of.append(at[-1])
        often = np.ones(sum(map(len, at)))
        often[len(often) - len(names) :] = n
        at, of = np.concatenate(at) * DIMS, np.concatenate(of)
        for j in range(NONZERO):
            to[names] += np.bincount(at + place[of, j], sign[of, j] * often, len(names) * DIMS).reshape(-1, DIMS)

    def pooled(self, vectors: np.ndarray) -> np.ndarray:
        """FEATURES for each text; zeros for one without words."""
        n = len(self.counts)
        out = np.zeros((n, FEATURES))
        some = np.flatnonzero(self.counts)
        if len(some):
            starts = (np.cumsum(self.counts) - self.counts)[some]
            out[some, :DIMS] = np.add.reduceat(vectors[self.bucket], starts, axis=0)
            for k in range(len(SHAPES)):
                out[:, DIMS + k] = np.bincount(self.text[self.shape == k], minlength=n)
            again = (self.code[1:] == self.code[:-1]) & (self.text[1:] == self.text[:-1])
            out[:, -3] = np.bincount(self.text[1:][again], minlength=n)
            different = np.unique(self.text * (int(self.code.max()) + 1) + self.code) // (int(self.code.max()) + 1)
            out[:, -2] = np.bincount(different, minlength=n)
            out[some] /= self.counts[some, None]
        out[:, -1] = np.log1p(self.counts)
        return out


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """A unit vector for each bucket (zeros for one without words), from all rows of docs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, sign = index_vectors()
        sums = np.zeros((BUCKETS, DIMS))  # whole numbers
        for batch in batches:
            texts = batch["text"].tolist()
            for rows in pieces_of([len(t or "") for t in texts], CHUNK_CHARS):
                Words(texts[rows]).add_contexts(sums, place, sign)
        some = np.flatnonzero(sums.any(axis=1))
        for k in range(0, len(some), 4096):
            of = some[k : k + 4096]
            out = pd.DataFrame(sums[of].astype(np.int64), columns=[f"v{j}" for j in range(DIMS)])
            out.insert(0, "bucket", of)
            yield out

    columns = [f"v{j}" for j in range(DIMS)]
    partial = docs.select(F.col(text_col).alias("text")).mapInPandas(run, "bucket long, " + ", ".join(f"{c} long" for c in columns))
    total = partial.groupBy("bucket").agg(*(F.sum(c).cast("double").alias(c) for c in columns))
    found = total.toArrow().to_pandas()  # BUCKETS rows at most
    out = np.zeros((BUCKETS, DIMS))
    out[found["bucket"].to_numpy()] = found[columns].to_numpy()
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


class Network(NamedTuple):
    """Two layers over standardised features; logits are divided by the temperature."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.centre) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def log_loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def temperature_of(logits: np.ndarray, y: np.ndarray) -> float:
    """What logits of unseen rows have to be divided by for the least log loss, from 0.25 to 16, by golden section."""
    lo, hi, ratio = math.log(0.25), math.log(16.0), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        if log_loss(logits / math.exp(a), y) < log_loss(logits / math.exp(b), y):
            hi = b
        else:
            lo = a
    return math.exp((lo + hi) / 2)


def fit(x: np.ndarray, y: np.ndarray, rate: float = 0.01, pull: float = 1e-3) -> Network:
    """Fitted on four fifths of the rows by Adam with all rows in each step; every fifth row sets the temperature. Where labels
    of both kinds are not among both parts, all rows get the share of label 1, drawn to one half by one row of each kind."""
    held = np.arange(len(y)) % 5 == 4
    train, rest = (x[~held], y[~held]), (x[held], y[held])
    if any(len(np.unique(part)) < 2 for part in (train[1], rest[1])):
        share = (float(y.sum()) + 1) / (len(y) + 2)
        return Network(np.zeros(FEATURES), np.ones(FEATURES), np.zeros((FEATURES, 1)), np.zeros(1), np.zeros(1), math.log(share / (1 - share)), 1.0)
    centre, scale = train[0].mean(axis=0), train[0].std(axis=0) + 1e-6
    z, t = (train[0] - centre) / scale, train[1]
    rng = np.random.default_rng(SEED)
    weights = [rng.normal(0, 1 / math.sqrt(FEATURES), (FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / math.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second = ([np.zeros_like(w) for w in weights] for _ in range(2))
    for step in range(1, STEPS + 1):
        w1, b1, w2, b2 = weights
        h = np.tanh(z @ w1 + b1)
        d = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -30, 30))) - t) / len(t)
        dh = np.outer(d, w2) * (1 - h * h)
        for k, g in enumerate((z.T @ dh + pull * w1, dh.sum(axis=0), h.T @ d + pull * w2, np.array([d.sum()]))):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            weights[k] = weights[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(centre, scale, weights[0], weights[1], weights[2], float(weights[3][0]), 1.0)
    return net._replace(temperature=temperature_of(net.logits(rest[0]), rest[1]))


class Model(NamedTuple):
    vectors: np.ndarray
    network: Network


def features(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    parts = [Words(texts[rows]).pooled(vectors) for rows in pieces_of([len(t or "") for t in texts], CHUNK_CHARS)]
    return np.concatenate(parts) if parts else np.zeros((0, FEATURES))


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels are never learned: crc32 of the id as text leaves 2 when divided by 4. Null: false."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = TRAIN_DOCS) -> Model:
    """Vectors from all of docs; the network from at most `bound` labelled documents (those of least hash) that are not held
    out. Repeated labels of a document count once, the larger; null labels not at all."""
    ids = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    ids = materialize(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound), "labels")  # at most `bound` rows
    text = docs.select(F.col(id_col).alias("_sw_doc"), F.col(text_col).alias("text"))
    chosen = ids.select(F.col("doc_id").alias("_sw_id"), "quality")
    vectors = word_vectors(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    @F.pandas_udf("array<double>")
    def pool(batch: pd.Series) -> pd.Series:
        return pd.Series(list(features(batch.tolist(), shared.value)), dtype=object)

    train = text.join(F.broadcast(chosen), F.col("_sw_doc") == F.col("_sw_id")).select("_sw_id", "quality", pool("text").alias("x"))
    rows = train.groupBy("_sw_id", "quality").agg(F.min("x").alias("x")).orderBy(F.xxhash64("_sw_id"), "_sw_id").toArrow().to_pandas()  # `bound` rows at most
    x = np.stack(rows["x"].to_list()).astype(float) if len(rows) else np.zeros((0, FEATURES))
    network = fit(x, rows["quality"].to_numpy().astype(float))
    discard(ids)
    return Model(vectors, network)


def quality_score(text: Column, docs: DataFrame, model: Model) -> Column:
    """The probability, from 0 to 1, that a text has the label 1; null and empty texts get that of a text without words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batch: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series(m.network.probability(features(batch.tolist(), m.vectors)))

    return score(text)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted. Equal rows stay apart; an empty table gives an empty
    one; without labels of both kinds all get the same score."""
    model = train_model(docs, labels, id_col, text_col)
    out = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), quality_score(F.col(text_col), docs, model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op13_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
