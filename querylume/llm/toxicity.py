"""Toxicity: subword-bag embeddings averaged into a linear softmax, all trained together in numpy.

A word is the mean of the vectors of itself and its character n-grams, hashed into buckets; a text is the
mean of its distinct words.  The softmax over it and the vectors are fitted together by Adagrad on a
bounded sample.  As everything up to the softmax is a mean, a word adds a fixed amount before averaging;
workers keep those amounts, so a spelling never seen still gets what its n-grams say.

A few words among thousands vanish in a long text's mean.  So a text is scored by all its passages of
PASSAGE words in a row, one from each word on, and its highest passage counts; scores are calibrated on such margins.
After the whole texts, training goes on with the passages that the model itself holds highest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS, Shared, bounded_arrow_batches, is_held_out, raw_bytes
from .labelled import calibration, logistic, split_of, training_sample

BUCKETS, SHORTEST, LONGEST = 1 << 16, 3, 5
#: Words of a passage; a shorter one is averaged as if words that say nothing filled it.
PASSAGE = 4
#: Bytes of a word; longer ones count as the stretches that make them up.
STRETCH = 64


def subwords(word: bytes) -> list[int]:
    """Buckets of the whole word and its byte n-grams, with marks at its ends."""
    marked = b"<" + word + b">"
    grams = [marked[i : i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(len(marked) - n + 1)]
    return [zlib.crc32(g) % BUCKETS for g in (b"=" + word, *grams)]


def stretches(words: list[bytes]) -> list[bytes]:
    """The words, each of more than STRETCH bytes as the consecutive stretches that make it up.

    So unspaced scripts are scored along their whole length, and no word's n-grams are left out.
    Neighbouring stretches share LONGEST - 1 bytes, so that every n-gram of the word is in one of them.
    """
    if max(map(len, words), default=0) <= STRETCH:
        return words
    step = STRETCH - LONGEST + 1
    return [w[i : i + STRETCH] for w in words for i in range(0, max(1, len(w) - LONGEST + 1), step)]


class Subwords(dict):
    """Word -> its buckets, kept for the words met first."""

    def __missing__(self, word: bytes) -> list[int]:
        out = subwords(word)
        if len(self) < 30_000:
            self[word] = out
        return out


def bag(words: list[bytes], known: Subwords) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a whole text, ascending, and their share in the mean of its distinct words."""
    parts = [known[w] for w in set(words)]
    lengths = np.array([len(p) for p in parts], dtype=np.int64)
    places = np.fromiter((b for p in parts for b in p), np.int64, int(lengths.sum()))
    place, at = np.unique(places, return_inverse=True)
    shares = np.repeat(1 / (lengths * max(1, len(parts))), lengths)
    return place.astype(np.int32), np.bincount(at, weights=shares, minlength=len(place)).astype(np.float32)


class Embeddings:
    def __init__(self, size: int, seed: int):
        rng = np.random.default_rng(seed)
        self.vectors = (rng.standard_normal((BUCKETS, size)) / size).astype(np.float32)
        self.softmax, self.bias = rng.standard_normal((size, 2)).astype(np.float32), np.zeros(2, dtype=np.float32)

    def gradients(self, place: np.ndarray, share: np.ndarray, lengths: list[int], y: np.ndarray) -> tuple[float, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Mean cross-entropy of texts with these buckets and shares, one after the other, and its slopes."""
        doc = np.repeat(np.arange(len(lengths)), lengths)
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        means = np.add.reduceat(self.vectors[place] * share[:, None], starts, axis=0)
        logits = means @ self.softmax + self.bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        loss = float(-np.log(p[np.arange(len(y)), y]).mean())
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        back = p @ self.softmax.T
        slope = np.stack([np.bincount(place, weights=share * back[doc, k], minlength=BUCKETS) for k in range(self.vectors.shape[1])], axis=1)
        return loss, (slope, means.T @ p, p.sum(axis=0))

    def train(self, bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int, rate: float, batch: int, drop: float, decay: float, seed: int) -> None:
        """Adagrad on the mean cross-entropy; `drop` of a text's buckets are left out at random, `decay` shrinks vectors."""
        rng = np.random.default_rng(seed)
        squares = [np.full_like(p, 1e-8) for p in (self.vectors, self.softmax, self.bias)]
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), batch):
                chosen = order[at : at + batch]
                place = np.concatenate([bags[i][0] for i in chosen])
                share = np.concatenate([bags[i][1] for i in chosen])
                share = share * (rng.random(len(share), dtype=np.float32) >= drop) / (1 - drop)
                _, (slope, *rest) = self.gradients(place, share, [len(bags[i][0]) for i in chosen], y[chosen])
                slope += decay * self.vectors
                for parameter, square, gradient in zip((self.vectors, self.softmax, self.bias), squares, (slope, *rest), strict=True):
                    square += gradient**2
                    parameter -= rate * gradient / np.sqrt(square)

    def amounts(self) -> np.ndarray:
        """What each bucket adds to the log odds of label 1, before averaging."""
        return self.vectors @ (self.softmax[:, 1] - self.softmax[:, 0])


class WordAmounts(dict):
    """Word -> its amount, kept for the words met first."""

    def __init__(self, amounts: np.ndarray, limit: int = 400_000):
        self.amounts, self.limit = amounts, limit

    def __missing__(self, word: bytes) -> float:
        out = float(self.amounts[subwords(word)].mean())
        if len(self) < self.limit:
            self[word] = out
        return out


def passage_means(words: list[bytes], amounts: WordAmounts) -> np.ndarray:
    x = np.fromiter(map(amounts.__getitem__, words), np.float64, len(words))
    if len(x) <= PASSAGE:
        return np.array([x.sum() / PASSAGE])
    return sum(x[i : len(x) - PASSAGE + 1 + i] for i in range(PASSAGE)) / PASSAGE


def highest_apart(means: np.ndarray, most: int) -> list[int]:
    """The first words of the `most` highest passages that share no word."""
    chosen: list[int] = []
    for i in np.argsort(-means, kind="stable"):
        if all(abs(i - c) >= PASSAGE for c in chosen):
            chosen.append(int(i))
            if len(chosen) == most:
                break
    return chosen


def highest_passage(words: list[bytes], amounts: WordAmounts) -> float:
    """Mean amount of the passage with the highest one; 0 without words."""
    return float(passage_means(words, amounts).max())


def refine(net: Embeddings, texts: list[bytes], y: np.ndarray, rounds: int, epochs: int, most: int, known: Subwords, seed: int, **options) -> None:
    """Train on passages: of a text with label 1 its highest one, of the others their `most` highest ones."""
    for r in range(rounds):
        amounts, bags, labels = WordAmounts(net.amounts(), 100_000), [], []
        for text, label in zip(texts, y, strict=True):
            words = text.split()
            means = passage_means(words, amounts)
            for i in highest_apart(means, 1 if label else most):
                passage = words[i : i + PASSAGE]
                place, share = bag(passage, known)
                bags.append((place, share * np.float32(len(set(passage)) / PASSAGE)))
                labels.append(label)
        net.train(bags, np.array(labels), epochs, seed=seed + r, **options)


class Model:
    def __init__(self, amounts: np.ndarray, slope: float, intercept: float):
        self.amounts, self.slope, self.intercept = amounts, slope, intercept

    def scores(self, texts: list[bytes], words: WordAmounts) -> np.ndarray:
        margins = np.array([highest_passage(stretches(t.translate(WORDS).split()), words) for t in texts])
        return logistic(self.slope * margins + self.intercept)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = 4000, size: int = 8, epochs: int = 6, rate: float = 0.1, batch: int = 32, drop: float = 0.5, decay: float = 1e-6, rounds: int = 3, seed: int = 5) -> Model:
    """The model from a bounded sample: about `rows` labelled rows reach the driver.

    Without labels of both kinds every text scores the share of label 1 (0.5 without any label).
    """
    sample, share = training_sample(docs, labels, label, rows, seed)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Subwords()
        for batch in batches:
            texts = [stretches(t.translate(WORDS).split()) for t in raw_bytes(batch.column(1))]
            bags = [bag(t, known) for t in texts]
            columns = [batch.column(0), pa.array([a.tobytes() for a, _ in bags], pa.binary()), pa.array([b.tobytes() for _, b in bags], pa.binary()), pa.array([b" ".join(t) for t in texts], pa.binary()), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "place", "share", "words", "y"])

    got = sorted(sample.mapInArrow(encode, "doc_id long, place binary, share binary, words binary, y int").collect(), key=lambda r: r["doc_id"])
    bags = [(np.frombuffer(r["place"], np.int32), np.frombuffer(r["share"], np.float32)) for r in got]
    y, ids = np.array([r["y"] for r in got], dtype=np.int64), np.array([r["doc_id"] for r in got], dtype=np.int64)
    full = np.array([len(b[0]) > 0 for b in bags], dtype=bool)
    fitted, checked = np.flatnonzero(full & ~split_of(ids)), np.flatnonzero(full & split_of(ids))
    if len(set(y[fitted].tolist())) < 2:
        return Model(np.zeros(BUCKETS), 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    net = Embeddings(size, seed)
    options = {"rate": rate, "batch": batch, "drop": drop, "decay": decay}
    net.train([bags[i] for i in fitted], y[fitted], epochs, seed=seed, **options)
    refine(net, [got[i]["words"] for i in fitted], y[fitted], rounds, 5, 3, Subwords(), seed, **options | {"batch": 4 * batch})
    words = WordAmounts(net.amounts(), 100_000)
    margins = np.array([highest_passage(got[i]["words"].split(), words) for i in checked])
    return Model(words.amounts, *calibration(margins, y[checked], share))


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs, repeated rows and null ids included.

    A null or empty text, or one without words, scores what the bias says.  Only text is read besides doc_id.
    """
    bounded_arrow_batches(docs.sparkSession)
    told = Shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordAmounts(told.value.amounts)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(told.value.scores(raw_bytes(batch.column(2)), words))], names=["doc_id", "held_out", "score"])

    named = docs.select(docs["doc_id"].cast("long").alias("doc_id"), is_held_out(docs["doc_id"], 5, 0).alias("held_out"), "text")
    return named.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
