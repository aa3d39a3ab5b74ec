"""Exact top-k inner products by a three-phase uniform threshold, in blocks of queries.

A vector's dimensions are cut into slices; each slice ranks the candidates by its part of the score.
Phase one gathers every slice's local top-k and scores their union exactly: the k-th best, tau, is a lower
bound of the final k-th score.  Phase two broadcasts tau; a candidate whose part is below tau / slices in
every slice cannot reach tau, so each slice only hands on what is at or above it.  Phase three resolves
those exactly and keeps what reaches tau.  Each task sends at most k rows a query in either round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_arrow_batches, sliced

#: Bytes of the queries in a block, about, and scores that a task holds of each slice: bounds of the broadcast and of its memory.
BLOCK_BYTES, SCORES = 2 << 20, 2 << 20


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and the vector as whole numbers floor(256 * x); null or non-finite vectors and null ids go."""
    x = vectors["embedding"]
    finite = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where(finite & vectors["vec_id"].isNotNull()).select(
        vectors["vec_id"].cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * 256)).alias("q")
    )


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows padded with zeros, or cut, to `width`; what a query lacks cannot count."""
    ends = column.offsets.to_numpy()
    lengths, flat = np.diff(ends), column.values.slice(ends[0], ends[-1] - ends[0]).to_numpy()
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    for i, (a, n) in enumerate(zip(ends[:-1] - ends[0], lengths, strict=True)):
        out[i, : min(n, width)] = flat[a : a + min(n, width)]
    return out


def exact_type(queries: np.ndarray, limit: int) -> type:
    """float64 holds all sums exactly while they stay under 2**53; beyond that integers multiply."""
    most = int(np.abs(queries).max(initial=0))
    return np.float64 if most * limit * max(1, queries.shape[1]) < 2**53 else np.int64


def best_rows(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query: highest score, then smallest id."""
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    first = np.r_[0, np.flatnonzero(np.diff(query)) + 1] if len(query) else np.zeros(0, int)
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
    keep = rank < k
    return query[keep], ids[keep], scores[keep]


def scan(block, slices: int, k: int, cutoff, largest: int):
    """A mapInArrow function.  Without a cutoff: phase one.  With it, one score a query: phases two and three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = block.value
        tau = None if cutoff is None else cutoff.value
        kind = exact_type(queries, largest)
        q = queries.astype(kind)
        cuts = np.array_split(np.arange(q.shape[1]), slices)
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))

        def merge(found: list[tuple]) -> tuple:
            return best_rows(*(np.concatenate(x) for x in zip(*found, strict=True)), k)

        for batch in sliced(batches, max(1, SCORES // len(q))):
            ids = batch.column(0).to_numpy()
            c = matrix(batch.column(1), q.shape[1]).astype(kind)
            parts = [q[:, cut] @ c[:, cut].T for cut in cuts]
            if tau is None:
                rows, cols = [], []
                for part in parts:
                    local = np.argpartition(-part, min(k, len(ids) - 1), axis=1)[:, : k + 1]
                    rows.append(np.repeat(np.arange(len(q)), local.shape[1]))
                    cols.append(local.ravel())
                pairs = np.unique(np.concatenate(rows) * len(ids) + np.concatenate(cols))
                row, col = pairs // len(ids), pairs % len(ids)
            else:
                enough = np.zeros(parts[0].shape, dtype=bool)
                for part in parts:
                    enough |= part * slices >= tau[:, None]
                row, col = np.nonzero(enough)
            exact = sum(part[row, col] for part in parts).astype(np.int64)
            keep = ids[col] != query_ids[row]
            if tau is not None:
                keep &= exact >= tau[row]
            held = merge([held, best_rows(row[keep], ids[col][keep], exact[keep], k)])
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[held[0]]), pa.array(held[1]), pa.array(held[2])], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, slices: int = 4) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best other vectors, ties to the smaller vec_id.

    `vectors` has vec_id and q (see whole_vectors).  Components past the query's length, or missing ones,
    count as zero.  Repeated rows are candidates of their own; a repeated query id is one query, with its
    smallest vector.  Rows with a query's own id are never its candidates.  No queries, or no candidates,
    give no rows.  Queries are taken in blocks of about BLOCK_BYTES by a hash of the id: a block is what is
    broadcast, and each block scans all candidates twice.  Whole numbers so large that a score might not fit
    into 64 bits raise an OverflowError.
    """
    spark = vectors.sparkSession
    bounded_arrow_batches(spark)
    queries = vectors.where(is_query).groupBy("vec_id").agg(F.min("q").alias("q"))
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("width")).first()
    n, width = size["n"], max(1, size["width"] or 1)
    most = vectors.agg(F.max(F.array_max(F.transform("q", lambda v: F.abs(v)))).alias("m")).first()["m"] or 0
    shape = "query_id long, vec_id long, score long"
    if most * most * width >= 2**63:
        raise OverflowError(f"scores of {width} whole numbers of up to {most} do not fit into 64 bits")
    blocks = -(-n * width * 8 // BLOCK_BYTES)
    out = spark.createDataFrame([], shape)
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()
        if not rows:
            continue
        width = max(len(r["q"]) for r in rows)
        packed = np.zeros((len(rows), width), dtype=np.int64)
        for i, r in enumerate(rows):
            packed[i, : len(r["q"])] = r["q"]
        ids = np.array([r["vec_id"] for r in rows], dtype=np.int64)
        block = spark.sparkContext.broadcast((ids, packed))
        gathered = ranked(vectors.mapInArrow(scan(block, slices, k, None, most), shape), k)
        kth = {r["query_id"]: r["tau"] for r in gathered.groupBy("query_id").agg(F.min("score").alias("tau"), F.count("*").alias("n")).where(F.col("n") >= k).collect()}
        tau = spark.sparkContext.broadcast(np.array([kth.get(int(i), -(2**62)) for i in ids]))
        found = vectors.mapInArrow(scan(block, slices, k, tau, most), shape)
        out = found if blocks == 1 else out.unionByName(found)
    return ranked(out, k).select("query_id", "rank", "vec_id", "score")


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """Spark drops ranks over k before the shuffle too, so no task gets more than k rows a query and task."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
