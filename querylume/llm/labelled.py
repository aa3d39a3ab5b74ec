"""What the two text classifiers share: a bounded sample of labelled rows, and calibrated scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import is_held_out, written


def hashed_share(key: Column, rows: int, total: int, seed: int) -> Column:
    """True for about `rows` of `total` keys, chosen by a hash; for all of them if there are no more."""
    if total <= rows:
        return F.lit(True)
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) < int((1 << 40) * rows / total)


#: Bytes of text in a training sample, at most.
SAMPLE_BYTES = 64 << 20


def fitting(sizes: list[tuple[int, int]], most: int) -> list[int]:
    """Ids of (id, bytes) left out so that the others, taken in this order, have `most` bytes at most."""
    left, held = [], 0
    for doc_id, size in sizes:
        if held + size > most:
            left.append(doc_id)
        else:
            held += size
    return left


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, seed: int, sample_bytes: int = SAMPLE_BYTES) -> tuple[DataFrame, float]:
    """About `rows` labelled training rows as (doc_id, text, y), half of each label where there are enough, and
    the share of label 1 among all training labels.

    Training rows are those with crc32(doc_id as text) mod 5 other than 0.  A label counts if it is 0 or 1;
    an id with both, or none, is left out.  A row is taken if a hash of
    its id is under a share of the hash's range, so nothing is sorted, and no more than a few deviations of
    sqrt(rows) over `rows` are ever taken.  The sample's ids are broadcast to the documents; only its own texts
    are shuffled.  Its rows have `sample_bytes` of text at most: in a hashed order, what no longer fits is left out, so
    what training brings to the driver is bounded in bytes too.  An id with several texts counts with the first
    in the order of their bytes.
    """
    known = labels.where(labels[label].isin(0, 1) & labels["doc_id"].isNotNull() & ~is_held_out(labels["doc_id"], 5, 0))
    one = known.groupBy(labels["doc_id"].cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("top")).where("y = top").drop("top")
    counts = {r["y"]: r["n"] for r in one.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    drawn = [(F.col("y") == y) & hashed_share(F.col("doc_id"), rows // 2, counts.get(y, 0), seed) for y in (0, 1)]
    ids = F.broadcast(one.where(drawn[0] | drawn[1]))
    named = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    sample = written(named.join(ids, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y"), "sample")
    sizes = sample.select(F.xxhash64("doc_id", F.lit(seed + 1)).alias("h"), "doc_id", F.octet_length("text").alias("n")).collect()  # a row each
    return sample.where(~F.col("doc_id").isin(fitting([(r["doc_id"], r["n"]) for r in sorted(sizes)], sample_bytes))), share


def split_of(ids: np.ndarray, parts: int = 4) -> np.ndarray:
    """True for the quarter of the sample that calibrates instead of fitting."""
    mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    return mixed % np.uint64(parts) == 0


def calibration(margins: np.ndarray, y: np.ndarray, share: float, rounds: int = 100) -> tuple[float, float]:
    """Slope and intercept of the logistic curve through the margins, with the sample's balance undone.

    Targets are smoothed, as Platt does, so that separable margins give finite slopes.
    """
    pos, neg = float(y.sum()), float(len(y) - y.sum())
    if not pos or not neg:
        return 1.0, float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = margins.std() or 1.0
    x, a, b = margins / scale, 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, w = p - target, p * (1 - p) + 1e-6
        h = np.array([[(w * x * x).sum(), (w * x).sum()], [(w * x).sum(), w.sum()]]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, [(g * x).sum(), g.sum()])
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    share = min(max(share, 1e-3), 1 - 1e-3)
    return float(a / scale), float(b + np.log(share / (1 - share)) - np.log(pos / neg))


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))
