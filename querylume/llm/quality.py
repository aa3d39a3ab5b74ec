"""Quality classifier: Naive Bayes support vectors.

Features are indicators of hashed n-grams: unigrams and bigrams of words and punctuation, bigrams of token
shapes, and how often a token follows itself.  Each is scaled by its class log-count ratio, a text's
features are scaled to unit length, and a linear hinge-loss model is fitted to them by dual coordinate
descent.  Margins become probabilities by a curve fitted to margins of folds that a model was not fitted on.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, bounded_arrow_batches, is_held_out, strings
from .labelled import calibration, logistic, training_sample

TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Hashed features.
WIDTH = 1 << 18


class TokenHashes(dict):
    def __missing__(self, token: str) -> int:
        out = zlib.crc32(token.encode("utf-8", "replace"))
        if len(self) < 300_000 and len(token) <= 64:
            self[token] = out
        return out


def shape(token: str) -> str:
    """Punctuation stands for itself; words for their case, or for having digits."""
    if not (token[0].isalnum() or token[0] == "_"):
        return token
    if any(c.isdigit() for c in token):
        return "0"
    return "AA" if token.isupper() and len(token) > 1 else "Aa" if token[:1].isupper() else "aa" if token.islower() else "x"


class ShapeHashes(dict):
    def __missing__(self, token: str) -> int:
        out = zlib.crc32(b"shape " + shape(token).encode("utf-8", "replace"))
        if len(self) < 300_000 and len(token) <= 64:
            self[token] = out
        return out


class Hashes:
    """A worker's caches of token and shape hashes."""

    def __init__(self):
        self.tokens, self.shapes = TokenHashes(), ShapeHashes()


def paired(a: np.ndarray) -> np.ndarray:
    out = a[:-1] * np.uint64(0x9E3779B1) + a[1:] * np.uint64(0x85EBCA77) + np.uint64(1)
    return out ^ (out >> np.uint64(29))


def features(text: str, hashes: Hashes) -> np.ndarray:
    """Distinct hashed n-grams of a whole text, ascending."""
    found = TOKEN.findall(text)
    one = np.fromiter(map(hashes.tokens.__getitem__, found), np.uint64, len(found))
    shapes = np.fromiter(map(hashes.shapes.__getitem__, found), np.uint64, len(found))
    repeats = int((one[1:] == one[:-1]).sum())
    often = np.arange(np.uint64(min(8, repeats.bit_length())), dtype=np.uint64) + np.uint64(zlib.crc32(b"repeats"))
    return np.unique(np.concatenate([one, paired(one), paired(shapes), often]) % np.uint64(WIDTH)).astype(np.int64)


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0, least: int = 2) -> np.ndarray:
    """0 for features in fewer than `least` rows, which say nothing about other texts."""
    counts = {c: np.zeros(WIDTH) for c in (0, 1)}
    for x, c in zip(rows, y, strict=True):
        counts[int(c)][x] += 1
    share = {c: (n + smooth) / (n + smooth).sum() for c, n in counts.items()}
    return np.where(counts[0] + counts[1] >= least, np.log(share[1]) - np.log(share[0]), 0.0)


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int, seed: int) -> np.ndarray:
    """Weights (the last one is the bias) that minimise |w|^2 / 2 + sum of cost * hinge loss; y is 1 or -1."""
    rng, w, alpha = np.random.default_rng(seed), np.zeros(WIDTH + 1), np.zeros(len(rows))
    square = np.array([v @ v + 1 for v in values])
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i] + w[-1]) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                w[-1] += step
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-3:
            break
    return w


class Model:
    def __init__(self, ratios: np.ndarray, weights: np.ndarray, slope: float, intercept: float):
        self.square, self.weights, self.bias = ratios**2, weights[:-1] * ratios, weights[-1]
        self.slope, self.intercept = slope, intercept

    def margin(self, x: np.ndarray) -> float:
        return float(self.weights[x].sum() / (np.sqrt(self.square[x].sum()) or 1.0) + self.bias)

    def scores(self, texts: list[str], hashes: Hashes) -> np.ndarray:
        margins = np.array([self.margin(features(t, hashes)) for t in texts])
        return logistic(self.slope * margins + self.intercept)


def fitted(rows: list[np.ndarray], y: np.ndarray, cost: float, epochs: int, seed: int) -> Model:
    """Both labels weigh the same, however many rows have them."""
    ratios = log_count_ratios(rows, y)
    values = [ratios[x] / (np.linalg.norm(ratios[x]) or 1.0) for x in rows]
    balance = {c: len(rows) / (2 * max(1, int((y == c).sum()))) for c in (0, 1)}
    costs = np.array([cost * balance[int(c)] for c in y])
    return Model(ratios, dual_coordinate_descent(rows, values, 2 * y - 1, costs, epochs, seed), 1.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = 8000, cost: float = 1.0, epochs: int = 20, folds: int = 3, seed: int = 7) -> Model:
    """The model from a bounded sample: about `rows` labelled rows reach the driver, as hashed features.

    Without labels of both kinds every text scores the share of label 1 (0.5 without any label).
    """
    sample, share = training_sample(docs, labels, label, rows, seed)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            x = [features(t, hashes).astype(np.int32).tobytes() for t in strings(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary()), batch.column(2)], names=["doc_id", "x", "y"])

    got = [r for r in sorted(sample.mapInArrow(encode, "doc_id long, x binary, y int").collect(), key=lambda r: r["doc_id"]) if r["x"]]
    x = [np.frombuffer(r["x"], np.int32) for r in got]
    y = np.array([r["y"] for r in got], dtype=np.int64)
    if min((int((y == c).sum()) for c in (0, 1))) < folds:
        return Model(np.zeros(WIDTH), np.zeros(WIDTH + 1), 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    fold = np.zeros(len(y), dtype=np.int64)
    for c in (0, 1):
        fold[y == c] = np.arange(int((y == c).sum())) % folds
    margins = np.empty(len(y))
    for k in range(folds):
        inside = np.flatnonzero(fold != k)
        part = fitted([x[i] for i in inside], y[inside], cost, epochs, seed)
        margins[fold == k] = [part.margin(x[i]) for i in np.flatnonzero(fold == k)]
    model = fitted(x, y, cost, epochs, seed)
    model.slope, model.intercept = calibration(margins, y, share)
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs, repeated rows and null ids included.

    A null or empty text has no features and scores what the bias says.  Only text is read besides doc_id.
    """
    bounded_arrow_batches(docs.sparkSession)
    told = Shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(told.value.scores(strings(batch.column(2)), hashes))], names=["doc_id", "held_out", "score"])

    named = docs.select(docs["doc_id"].cast("long").alias("doc_id"), is_held_out(docs["doc_id"], 5, 0).alias("held_out"), "text")
    return named.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """`docs` without the rows that score under the threshold; what is kept is unchanged."""
    model = Shared(docs.sparkSession, fit(docs, labels, **options))
    bounded_arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            yield batch.filter(pa.array(model.value.scores(strings(batch.column("text")), hashes) >= threshold))

    return docs.mapInArrow(run, docs.schema)
