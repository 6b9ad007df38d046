"""Toxicity (FTRL-proximal) and quality (Naive Bayes support vectors) over hashed n-grams.

Fitting takes a *bounded sample* of labelled rows: the ``sample`` labelled ids whose hash is smallest
(default 12,000).  Only their hashed features reach the fit, never the texts: they are written as a table and
read partition by partition into one array, whose size is counted beforehand.  Scoring covers every row;
only the weights that are not zero are sent, and each task spreads them over 2**bits places.

Defined results: null and empty texts have no features and get the score of the bias; labels that
are null are not used; several labels of one document count one each; with labels of one class
only, the bias alone decides; without any labelled row no text counts as toxic (score 0.27); rows that repeat a doc_id are scored separately; columns of any other name pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHash, as_bytes, crc_mod, keep, table
from .features import ShapeHash, style_features, word_features

BITS = 20
SAMPLE = 12_000


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Examples:
    """Feature sets of labelled rows in one array: where each starts, its size and its label."""

    features: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    labels: np.ndarray

    @classmethod
    def of(cls, rows) -> Examples:
        rows = list(rows)
        sizes = np.array([len(x) for x, _ in rows], np.int64)
        return cls(np.concatenate([np.empty(0, np.uint32), *(x for x, _ in rows)]), np.cumsum(sizes) - sizes, sizes, np.array([y for _, y in rows], np.int64))

    def __len__(self) -> int:
        return len(self.labels)

    def __getitem__(self, k: int) -> np.ndarray:
        return self.features[self.starts[k] : self.starts[k] + self.sizes[k]]

    def only(self, wanted: np.ndarray) -> Examples:
        """The same rows with the features at which ``wanted`` is true."""
        if sum(np.count_nonzero(wanted[self[k]]) for k in range(len(self))) == len(self.features):
            return self
        return Examples.of((x[wanted[x]], y) for x, y in zip(map(self.__getitem__, range(len(self))), self.labels, strict=True))

    def documents(self, bits: int, label: bool | None = None) -> np.ndarray:
        """How many rows (of a label) have each feature; a piece at a time, as counting widens its input."""
        out = np.zeros(1 << bits, np.int64)
        for at in range(0, len(self), 512):
            part = [self[k] for k in range(at, min(at + 512, len(self))) if label is None or bool(self.labels[k]) == label]
            if part:
                out += np.bincount(np.concatenate(part), minlength=1 << bits)
        return out


@dataclass
class Weights:
    """The weights that are not zero: places, one row of values per kind, and the biases."""

    at: np.ndarray
    values: np.ndarray
    bias: np.ndarray
    bits: int = BITS

    def dense(self) -> np.ndarray:
        out = np.zeros((len(self.values), 1 << self.bits), np.float32)
        out[:, self.at] = self.values
        return out


class Ftrl:
    """FTRL-proximal logistic regression with per-coordinate rates and L1 sparsity."""

    def __init__(self, bits: int = BITS, alpha: float = 3.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((2, (1 << bits) + 1))

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = sigmoid(w.sum()) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    @classmethod
    def fit(cls, rows: Examples, bits: int = BITS, epochs: int = 3, **settings) -> Weights:
        """A gradient is at most 1, so a feature seen ``c`` times in all epochs keeps a zero weight while c <= l1:
        such features are left out, which changes no other weight."""
        model, bias, rng = cls(bits, **settings), 1 << bits, np.random.default_rng(7)
        rows = rows.only(epochs * rows.documents(bits) > model.l1)
        for _ in range(epochs):
            for k in rng.permutation(len(rows)):
                model.learn(np.append(rows[k], bias), int(rows.labels[k]))
        seen = np.flatnonzero(np.abs(model.z[:-1]) > model.l1)
        w, last = model.weights(seen).astype(np.float32), model.weights(np.array([bias])).astype(np.float32)
        if not len(rows):
            last -= 1
        return Weights(seen[w != 0].astype(np.uint32), w[None, w != 0], last, bits)


def fit_nbsvm(rows: Examples, bits: int = BITS, smooth: float = 1.0, c: float = 0.1, epochs: int = 12, blend: float = 0.25, least: int = 3) -> Weights:
    """Log-count ratios scale the indicators; dual coordinate descent fits the hinge loss.

    The vocabulary is the features of at least ``least`` sampled documents.  Rows are scaled to length 1; the bound of the
    dual variables is larger for the rarer class.  As published, the result is interpolated with the model's
    mean magnitude, (1 - blend) * mean|w| + blend * w, which moves it towards Naive Bayes; the bias is the linear model's.
    Values of the result: ratios, then weights.
    """
    size, bias = 1 << bits, 1 << bits
    y = np.where(rows.labels != 0, 1.0, -1.0)
    pos, neg = (rows.documents(bits, label) for label in (True, False))
    n1, n0 = max(1, (y > 0).sum()), max(1, (y < 0).sum())
    r = np.where(pos + neg >= least, np.log((pos + smooth) / (n1 + 2 * smooth)) - np.log((neg + smooth) / (n0 + 2 * smooth)), 0.0)
    rows = rows.only(r != 0)
    r = np.append(r, 1.0)
    scale = np.array([1 / np.sqrt((r[rows[k]] ** 2).sum() + 1) for k in range(len(rows))])
    w, alpha, rng = np.zeros(size + 1), np.zeros(len(rows)), np.random.default_rng(7)
    top = np.where(y > 0, c, c * n1 / n0) * 10
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at = np.append(rows[k], bias)
            v = r[at] * scale[k]
            g = y[k] * (w[at] @ v) - 1
            new = min(max(alpha[k] - g, 0.0), top[k])
            if new != alpha[k]:
                w[at] += (new - alpha[k]) * y[k] * v
                alpha[k] = new
    at = np.flatnonzero(r[:-1])
    mean = np.abs(w[at]).mean() if len(at) else 0.0
    return Weights(at.astype(np.uint32), np.stack([r[at], (1 - blend) * mean + blend * w[at]]).astype(np.float32), w[-1:].astype(np.float32), bits)


def sampled(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """text, label and order of the ``sample`` labelled rows with the smallest hashes."""
    own = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label")).filter("label IS NOT NULL AND id IS NOT NULL")
    own = own.orderBy(F.xxhash64("id"), "id", "label").limit(sample)
    # At most ``sample`` pairs of numbers: the bound is what makes this broadcast safe.
    texts = docs.select(F.col("doc_id").alias("id"), as_bytes("text").alias("text"))
    return texts.join(F.broadcast(own), "id").select("text", "label", F.xxhash64("id").alias("at"))


def featured(rows: DataFrame, featurise: Callable[[], Callable[[bytes], np.ndarray]], bits: int = BITS, least: int = 3) -> Examples:
    """Features of the sampled rows, in the order of their hashes.

    Features of fewer than ``least`` rows stay behind: neither fit gives them a weight.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = featurise()
        for b in batches:
            found = [one(t).tobytes() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), b.column(1), b.column(2), pa.array([xxhash.xxh3_64_intdigest(x) >> 1 for x in found], pa.int64())], names=["x", "label", "at", "tie"])

    kept = keep(rows.mapInArrow(run, "x binary, label int, at long, tie long"), "features")
    # Two readings, partition by partition: how many rows have each feature, and then those that count.
    times = np.zeros(1 << bits, np.int32)
    for r in kept.select("x").toLocalIterator():
        times[np.frombuffer(r["x"], np.uint32)] += 1
    # A row has a feature once, so the counts tell how many entries are left.
    out, at, rows = np.empty(times[times >= least].sum(), np.uint32), 0, []
    for r in kept.toLocalIterator():
        x = np.frombuffer(r["x"], np.uint32)
        x = x[times[x] >= least]
        out[at : at + len(x)] = x
        rows.append((r["at"], r["tie"], r["label"], at, len(x)))
        at += len(x)
    labels, starts, sizes = np.array([r[2:] for r in sorted(rows)], np.int64).reshape(-1, 3).T
    return Examples(out, starts, sizes, labels)


def scored(docs: DataFrame, weights: Weights, featurise, margin, extra: dict[str, Column]) -> DataFrame:
    """doc_id, the ``extra`` columns, score and predicted for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    names = list(extra)
    src = docs.select(F.col("doc_id").cast("long"), as_bytes("text").alias("_t"), *(c.alias(n) for n, c in extra.items()))
    kinds = ", ".join(f"{n} {src.schema[n].dataType.simpleString()}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, w, bias = featurise(), sent.value.dense(), float(sent.value.bias[0])
        for b in batches:
            score = np.array([float(sigmoid(margin(w, bias, one(t)))) for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), *(b.column(2 + i) for i in range(len(names))), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", *names, "score", "predicted"])

    return src.mapInArrow(run, f"doc_id long, {kinds + ', ' if kinds else ''}score double, predicted int")


def toxicity_features(bits: int = BITS):
    def make():
        cache = WordHash()
        return lambda text: word_features(text, bits, cache)

    return make


def quality_features(bits: int = BITS):
    def make():
        cache, shapes = WordHash(), ShapeHash()
        return lambda text: style_features(text, bits, cache, shapes)

    return make


def linear_margin(w: np.ndarray, bias: float, x: np.ndarray) -> float:
    return float(w[0, x].sum(dtype=np.float64)) + bias


def scaled_margin(w: np.ndarray, bias: float, x: np.ndarray) -> float:
    """Margin of the log-count-ratio model; ``w`` holds ratios, then weights."""
    r = w[0, x].astype(np.float64)
    return 3.0 * (float(w[1, x] @ r) + bias) / np.sqrt(r @ r + 1)


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Weights:
    return Ftrl.fit(featured(sampled(docs, labels, "toxic", sample), toxicity_features()))


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Weights:
    return fit_nbsvm(featured(sampled(docs, labels, "quality", sample), quality_features()))


def score_toxicity(docs: DataFrame, weights: Weights, **extra: Column) -> DataFrame:
    return scored(docs, weights, toxicity_features(), linear_margin, extra)


def score_quality(docs: DataFrame, weights: Weights, **extra: Column) -> DataFrame:
    return scored(docs, weights, quality_features(), scaled_margin, extra)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = fit_toxicity(docs, labels.filter(crc_mod("doc_id", 5) != 0))
    return score_toxicity(docs, weights, held_out=crc_mod("doc_id", 5) == 0)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = fit_quality(docs, labels.filter(crc_mod("doc_id", 3) != 1))
    return score_quality(docs, weights, held_out=crc_mod("doc_id", 3) == 1)


def without_toxic(docs: DataFrame, weights: Weights) -> DataFrame:
    """Rows of ``docs`` scored below one half, all columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("boolean")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one, w, bias = toxicity_features()(), sent.value.dense(), float(sent.value.bias[0])
        for texts in batches:
            yield texts.map(lambda t: linear_margin(w, bias, one(bytes(t))) >= 0).astype(bool)

    return docs.filter(~toxic(as_bytes("text")))
