"""Near-duplicate classes by ProbMinHash, banding, exact verification and connected components.

Shingles are five words; a shingle's weight is 1 + ln(its count), so the registers of two texts agree with
the probability Jaccard similarity of their weighted shingle sets.  Texts that agree in a whole band share
a bucket.  A bucket is never expanded into all pairs: its texts are put in a hashed order, another in each
band, and neighbours are compared.  A pair is linked if the plain Jaccard similarity of the two texts'
shingle sets is at least the threshold.  Classes are the connected components of the links.

Neighbours join most buckets into one class.  A bucket that still holds several classes is compared whole if it
is small.  Larger ones that share texts become one group, which has a core, the shingles in most of its drawn
texts.  With d the shingles by which a text x and the core differ, and r = (1 - t) / (1 + t) for a threshold t, two
texts are linked exactly if |x ^ y| <= r (|x| + |y|), that is if their differences share at least half the sum
of their excesses |d| - r |x|.  All texts are compared with the one of least excess, the hub.  A pair whose
excesses sum to 0 or less is linked to the hub itself, so any other linked pair shares a difference; it shares one
among the first of both in a common order, the rarest first (prefix filtering).  Those pairs are compared.  So
no pair of a group is left out, and one class's texts are not paired with each other.

Equal texts are one node from the start.  Buckets are dealt out by range of (bucket, hashed order), so a
bucket of any size spreads over tasks, and the ends of tasks are joined up again.  Everything is hashed,
grouped and joined by Spark; links and components stay distributed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORDS, bounded_arrow_batches, discard, raw_bytes, written

SIGNED = "row_id long, bands array<long>, shingles binary, size int"
#: Texts, and bytes of their shingle sets, that are compared whole in one group.
WHOLE_TEXTS, WHOLE_BYTES = 512, 8 << 20
#: Whether larger ones are compared by their differences (0: by all pairs of blocks), and texts that a core is taken from.
LEVELS, DRAWN = 1, 32
#: Words whose hashes a worker keeps; others are hashed again.
CACHE = 300_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        out = xxhash.xxh3_64_intdigest(word) >> 1
        if len(self) < CACHE and len(word) <= 64:
            self[word] = out
        return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of `width` words; a shorter text is one shingle; no words, none."""
    n = min(width, len(words))
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - n + 1 + i]
    return mixed(out)


def prob_min_hash(elements: np.ndarray, weights: np.ndarray, doc: np.ndarray, docs: int, registers: int) -> np.ndarray:
    """For each document the element that arrives first in each register, as a (docs, registers) array.

    An element's arrivals are a Poisson process with its weight as rate, drawn from its own hash, each in a
    random register.  An element stops once its next arrival is later than all of its document's registers.
    """
    times = np.full(docs * registers, np.inf)
    winners = np.zeros(docs * registers, dtype=np.uint64)
    clock, turn = np.zeros(len(elements)), 0
    while len(elements):
        turn += 1
        seed = mixed(elements + np.uint64(turn * 0xD1B54A32D192ED03 % (1 << 64)))
        clock = clock - np.log((seed >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / weights
        place = doc * registers + (mixed(seed) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(times, place, clock)
        won = times[place] == clock
        winners[place[won]] = elements[won]
        latest = times.reshape(docs, registers).max(axis=1)
        going = clock < latest[doc]
        elements, weights, doc, clock = elements[going], weights[going], doc[going], clock[going]
    return winners.reshape(docs, registers)


def signer(width: int, bands: int, rows: int):
    """A mapInArrow function (row_id, text) -> SIGNED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_hashes = WordHashes()
        for batch in batches:
            ids, out, sets, start = batch.column(0), [], [], 0
            texts = raw_bytes(batch.column(1))
            while start < len(texts):
                hashes, weights, owner, size, end = [], [], [], 0, start
                while end < len(texts) and size < 400_000:
                    words = texts[end].translate(WORDS).split()
                    codes = np.fromiter(map(word_hashes.__getitem__, words), np.int64, len(words)).view(np.uint64)
                    found, count = np.unique(shingle_hashes(codes, width), return_counts=True)
                    hashes.append(found)
                    weights.append(1 + np.log(count))
                    owner.append(np.full(len(found), end - start))
                    sets.append(np.unique((found >> np.uint64(32)).astype(np.uint32)).tobytes())
                    size += len(found)
                    end += 1
                lengths = np.array([len(h) for h in hashes])
                won = prob_min_hash(np.concatenate(hashes), np.concatenate(weights), np.concatenate(owner), end - start, bands * rows) if size else np.zeros((end - start, bands * rows), dtype=np.uint64)
                keys = np.tile(np.arange(bands, dtype=np.uint64), (end - start, 1))
                for r in range(rows):
                    keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + won[:, r::rows])
                out.extend(k.view(np.int64) if n else np.zeros(0, np.int64) for k, n in zip(keys, lengths, strict=True))
                start = end
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, type=pa.list_(pa.int64())), pa.array(sets, type=pa.binary()), pa.array(map(len, sets), type=pa.int32())], names=["row_id", "bands", "shingles", "size"])

    return run


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (key, place, row_id) in order: pairs next to each other under one key, and, with a part, the task's two ends."""
    from pyspark import TaskContext

    part, first, last = TaskContext.get().partitionId(), None, None
    names = ["a", "b", "key", "part"]
    for batch in batches:
        keys, rows = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        if not len(keys):
            continue
        if first is None:
            first = (int(keys[0]), int(rows[0]))
        else:
            keys, rows = np.r_[last[0], keys], np.r_[last[1], rows]
        same = keys[1:] == keys[:-1]
        a, b = np.minimum(rows[1:], rows[:-1])[same], np.maximum(rows[1:], rows[:-1])[same]
        last = (int(keys[-1]), int(rows[-1]))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(keys[1:][same]), pa.nulls(len(a), pa.int64())], names=names)
    if first is not None:
        ends = [(first[1], None, first[0], 2 * part), (last[1], None, last[0], 2 * part + 1)]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*ends, strict=True)], names=names)


def verifier(threshold: float, names: list[str]):
    """A mapInArrow function: the pairs `names` whose shingle sets x and y are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                small, large = min(len(x), len(y)), max(len(x), len(y))
                both = len(np.intersect1d(x, y, assume_unique=True)) if small >= threshold * large else 0
                keep.append(both > 0 and both >= threshold * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(names).filter(pa.array(keep, type=pa.bool_()))

    return run


def block_links(threshold: float):
    """An applyInArrow function: the root pairs (a, b) of similar texts in a pair of blocks (row_id, root, x)."""

    def run(block: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.uint32) for x in block.column("x").to_pylist()]
        roots, sizes = block.column("root").to_numpy(), np.array([len(x) for x in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count[code] > 1
        owner, (distinct, code) = owner[shared], np.unique(code[shared], return_inverse=True)
        both = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(code, kind="stable")
        owner, code = owner[order], code[order]
        for at in range(0, len(distinct), 8192):
            low, high = np.searchsorted(code, [at, at + 8192])
            holds = np.zeros((len(sets), min(8192, len(distinct) - at)), np.float32)
            holds[owner[low:high], code[low:high] - at] = 1
            both += holds @ holds.T
        similar = (both > 0) & (both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9)
        x, y = np.nonzero(similar & (roots[:, None] < roots[None, :]))
        found = np.unique(np.stack([roots[x], roots[y]], axis=1), axis=0)
        return pa.table({"a": pa.array(found[:, 0], type=pa.int64()), "b": pa.array(found[:, 1], type=pa.int64())})

    return run


def core(texts: pa.Table) -> pa.Table:
    """An applyInArrow function: the shingles y that more than half of a bucket's drawn texts (key, x) hold."""
    sets = [np.frombuffer(x, np.uint32) for x in texts.column("x").to_pylist()]
    found, count = np.unique(np.concatenate(sets), return_counts=True)
    return pa.table({"key": texts.column("key").slice(0, 1), "y": pa.array([found[2 * count > len(sets)].tobytes()], pa.binary())})


def differences(threshold: float):
    """A mapInArrow function over texts (key, row_id, root, x) and their group's core y: sizes, differences from y and excesses."""
    slack = (1 - threshold) / (1 + threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, apart = [], []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                sizes.append(len(x) // 4)
                apart.append(np.setxor1d(np.frombuffer(x, np.uint32), np.frombuffer(y or b"", np.uint32), assume_unique=True).view(np.int32))
            excess = [len(d) - slack * n for d, n in zip(apart, sizes, strict=True)]
            columns = [pa.array(sizes, pa.int64()), pa.array(apart, pa.list_(pa.int32())), pa.array(excess, pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "row_id", "root")), *columns], names=["key", "row_id", "root", "n", "apart", "excess"])

    return run


def mixed_buckets(chain: DataFrame, roots: DataFrame, signed: DataFrame) -> DataFrame:
    """key, row_id, root, size, x (shingles) of the texts in buckets of three and more that hold several roots.

    `chain` holds the neighbours (key, a, b) of each bucket, so its n - 1 rows join all n texts of it.
    """
    root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias("r" + c))
    rooted = chain.join(root("a"), "a", "left").join(root("b"), "b", "left").withColumns({"ra": F.coalesce("ra", "a"), "rb": F.coalesce("rb", "b")})
    rooted = written(rooted.select("key", "a", "b", "ra", "rb"), "rooted", few=True)
    several = rooted.groupBy("key").agg(F.count("*").alias("links"), F.max(F.col("ra") != F.col("rb")).alias("mixed")).where("mixed and links > 1").select("key")
    several = written(several, "several", few=True)  # a table, as `nodes` is
    ends = F.explode(F.array(F.struct(F.col("a").alias("row_id"), F.col("ra").alias("root")), F.struct(F.col("b").alias("row_id"), F.col("rb").alias("root"))))
    texts = rooted.join(several, "key", "left_semi").select("key", ends.alias("t")).select("key", "t.*").distinct()
    out = written(texts.join(signed.select("row_id", "size", F.col("shingles").alias("x")), "row_id"), "mixed", few=True)
    discard(rooted)
    discard(several)
    return out


def missed_links(texts: DataFrame, threshold: float, levels: int = LEVELS) -> DataFrame:
    """Root pairs (a, b) of similar texts among the written `texts` of mixed_buckets().

    Small buckets are compared whole, larger ones by their differences; without `levels` these are compared whole
    too, by pairs of blocks.  Buckets of the same texts count once.
    """
    per_key = texts.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.bit_xor(F.xxhash64("row_id")).alias("mark"), F.min("root").alias("low"), F.max("root").alias("high"))
    per_set = per_key.where("low <> high").groupBy("n", "bytes", "mark").agg(F.min("key").alias("key"))
    blocks = F.greatest(F.ceil(F.col("n") / WHOLE_TEXTS), F.ceil(F.col("bytes") / WHOLE_BYTES), F.lit(1)).cast("long")
    buckets = written(per_set.select("key", "n", "bytes", blocks.alias("blocks")), "buckets", few=True)
    large = buckets.where("blocks > 1")
    found = [written(compared_whole(texts, buckets.where("blocks = 1") if levels else buckets, threshold), "whole", few=True)]
    if levels and not large.isEmpty():
        found.append(compared_by_differences(texts.join(large.select("key"), "key", "left_semi"), threshold))
    links = written(reduce(DataFrame.unionByName, found).distinct(), "missed", few=True)
    for old in [texts, buckets, *found]:
        discard(old)
    return links


def compared_by_differences(texts: DataFrame, threshold: float) -> DataFrame:
    """Root pairs (a, b) of all similar texts that share a bucket (key, row_id, root, size, x), without pairing all of them."""
    stars = texts.groupBy("key").agg(F.min("row_id").alias("b"))
    groups = components(texts.select("key", "row_id").join(stars, "key").select(F.col("row_id").alias("a"), "b"))  # each bucket is a star
    once = texts.groupBy("row_id", "root").agg(F.first("size").alias("size"), F.first("x").alias("x"))
    once = once.join(groups, F.col("row_id") == F.col("node"), "left").select(F.coalesce(groups["root"], "row_id").alias("key"), "row_id", once["root"], "size", "x")
    once = written(once, "grouped", few=True)
    sized = once.groupBy("key").agg(F.count("*").alias("count"), F.sum("size").alias("bytes"))
    share = F.least(F.lit(DRAWN), F.ceil(F.lit(4 * WHOLE_BYTES) * F.col("count") / F.col("bytes")))
    drawn = once.join(sized, "key").where(F.pmod(F.xxhash64("key", "row_id"), "count") < share)
    cores = written(drawn.select("key", "x").groupBy("key").applyInArrow(core, "key long, y binary").repartition(1), "cores")  # a table, as `nodes` is
    apart = once.join(cores, "key", "left").select("key", "row_id", "root", "x", "y")
    apart = written(apart.mapInArrow(differences(threshold), "key long, row_id long, root long, n long, apart array<int>, excess double"), "apart")
    hubs = apart.groupBy("key").agg(F.min(F.struct("excess", "row_id", "root")).alias("h")).select("key", F.col("h.excess").alias("least"), F.col("h.row_id").alias("hub"), F.col("h.root").alias("hub_root"))
    hubs = written(hubs.join(once.select(F.col("row_id").alias("hub"), F.col("x").alias("y")), "hub"), "hubs", few=True)
    near = once.join(hubs, "key").where(F.col("root") != F.col("hub_root")).select("key", "root", "hub_root", "x", "y")
    close = near.mapInArrow(verifier(threshold, ["key", "root", "hub_root"]), "key long, root long, hub_root long").distinct()
    close = written(close, "close", few=True)
    pairs = candidates(apart, hubs, close, threshold)
    sets = once.select("row_id", "root", "x")
    side = lambda c, x: sets.select(F.col("row_id").alias(c), F.col("root").alias("r" + c), F.col("x").alias(x))
    compared = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("ra", "rb", "x", "y")
    linked = compared.mapInArrow(verifier(threshold, ["ra", "rb"]), "ra long, rb long").unionByName(close.select(F.col("root").alias("ra"), F.col("hub_root").alias("rb")))
    out = written(linked.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "differing", few=True)
    for old in [once, cores, apart, hubs, close]:
        discard(old)
    return out


def candidates(apart: DataFrame, hubs: DataFrame, close: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of texts of different classes that share one of the first differences of both.

    A difference that one class alone has comes before all others, so no pair stems from it.  What a linked pair
    shares from its first common difference on is at least half the sum of its excesses, and at most what is left of either.
    """
    joined = apart.join(hubs.select("key", "least", F.col("hub_root").alias("h")), "key").join(close, ["key", "root"], "left")
    least_shared = F.when(F.coalesce("hub_root", "root") == F.col("h"), F.col("excess") - F.col("least")).otherwise(F.col("excess") + F.col("least")) / 2
    least_shared = F.greatest(F.lit(1), F.ceil(least_shared - 1e-6), F.ceil(F.size("apart") - F.col("n") * (1 - threshold) / threshold - 1e-6))
    classed = joined.select("key", "row_id", F.coalesce("hub_root", "root").alias("class"), "n", "excess", F.size("apart").alias("all"), (F.size("apart") - least_shared + 1).alias("first"), F.explode("apart").alias("shingle"))
    common = classed.groupBy("key", "shingle").agg(F.count("*").alias("often"), F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("key", "shingle", "often")
    mine = Window.partitionBy("row_id")
    place = F.row_number().over(mine.orderBy("often", "shingle")) + F.col("all") - F.count("*").over(mine)
    first = classed.join(common, ["key", "shingle"]).withColumn("place", place).where("place <= first").select("key", "shingle", "row_id", "class", "n", "excess", (F.col("all") - F.col("place") + 1).alias("left"))
    other = first.select("key", "shingle", *(F.col(c).alias(o) for c, o in (("row_id", "b"), ("class", "other_class"), ("n", "m"), ("excess", "other_excess"), ("left", "other_left"))))
    alike = (F.col("n") >= threshold * F.col("m") - 1e-6) & (F.col("m") >= threshold * F.col("n") - 1e-6)
    shared = (F.col("excess") + F.col("other_excess")) / 2 - 1e-6
    alike &= F.least("left", "other_left") >= shared
    met = first.withColumnRenamed("row_id", "a").join(other, ["key", "shingle"]).where((F.col("a") < F.col("b")) & (F.col("class") != F.col("other_class")) & alike)
    counted = met.groupBy("a", "b").agg(F.count("*").alias("seen"), F.min(F.least("left", "other_left")).alias("left"), F.first(shared).alias("shared"))
    return counted.where("seen + left - 1 >= shared").select("a", "b")


def compared_whole(texts: DataFrame, buckets: DataFrame, threshold: float) -> DataFrame:
    """Root pairs (a, b) of similar texts in buckets (key, blocks), by pairs of blocks to which texts are dealt by hash."""
    dealt = texts.join(buckets.select("key", "blocks"), "key").withColumn("block", F.pmod(F.xxhash64("row_id"), "blocks"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "row_id", "root", "x")
    return paired.groupBy("key", "i", "j").applyInArrow(block_links(threshold), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for all nodes of links (a, b): root is the smallest node of the component.

    Alternating large-star and small-star rounds.  Each node's smallest neighbour comes from an aggregate with
    map-side partial results, then the edges meet it in a join, which Spark splits where a node is hot.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", few=True)
    before = None
    while True:
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == tuple(mark):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = tuple(mark)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = written(small.distinct(), "edges", few=True)
        discard(edges)
        edges = after


def near_duplicates(docs: DataFrame, threshold: float = 0.8, width: int = 5, bands: int = 24, rows: int = 4) -> DataFrame:
    """row_id, doc_id, text_key, root: one row for each row of docs; rows of one class share the root, a row_id.

    A null text counts as empty.  Equal texts, empty ones too, are one class.  Other texts without words are
    classes of their own; a text under `width` words is one shingle.  Repeated rows and null ids are rows like
    others.  An empty table gives no rows.

    Two texts share no band with probability (1 - p**rows)**bands, where p is their probability Jaccard similarity:
    3e-6 by default for p = 0.8.  Where texts repeat their shingles unequally often, p is under the plain
    similarity by which they are linked: at plain 0.8, with the rest repeated 10, 30 or 100 times in one text
    only, p falls to about 0.62, 0.57 and 0.53, and the probability rises to about 2, 6 and 14 %.  Sets are
    compared by 32-bit hashes of shingles; two of n and m shingles agree by chance in n * m / 2**32 of them.
    Links depend on texts alone, not on the partitions of `docs`.
    """
    spark = docs.sparkSession
    bounded_arrow_batches(spark)
    text = F.coalesce(docs["text"], F.lit(""))
    keyed = docs.select(F.monotonically_increasing_id().alias("row_id"), docs["doc_id"].cast("long").alias("doc_id"), F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("text_key"), text.alias("text"))
    signed = written(keyed.mapInArrow(carry_keys(signer(width, bands, rows)), "doc_id long, text_key binary, " + SIGNED), "signed")
    nodes = written(signed.groupBy("text_key").agg(F.min("row_id").alias("node")), "nodes", few=True)  # a table: Spark splits a hot key's join only between plain exchanges
    members = written(signed.select("row_id", "doc_id", "text_key").join(nodes, "text_key"), "members", few=True)
    discard(nodes)
    alone = members.where("row_id = node").select("row_id")
    buckets = signed.select("row_id", "text_key", "bands").join(alone, "row_id", "left_semi").select("row_id", "text_key", F.explode("bands").alias("key"))
    placed = buckets.select("key", F.xxhash64("key", "text_key").alias("place"), "row_id")
    ordered = placed.repartitionByRange("key", "place").sortWithinPartitions("key", "place")
    met = written(ordered.mapInArrow(neighbours, "a long, b long, key long, part long"), "met")
    ends = met.where("part is not null").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("part", "a"))).alias("e"))
    across = ends.where(F.size("e") > 1).select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size("e") - 1), lambda i: F.struct(F.least(F.get("e", i)["a"], F.get("e", i - 1)["a"]).alias("a"), F.greatest(F.get("e", i)["a"], F.get("e", i - 1)["a"]).alias("b")))).alias("p")).select("key", "p.a", "p.b")
    chain = met.where("part is null").select("key", "a", "b").unionByName(across).where("a <> b")
    pairs = chain.select("a", "b").distinct()
    sets = signed.select("row_id", "shingles")
    compared = pairs.join(sets.select(F.col("row_id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("row_id").alias("b"), F.col("shingles").alias("y")), "b")
    links = compared.select("a", "b", "x", "y").mapInArrow(verifier(threshold, ["a", "b"]), "a long, b long")
    first = components(links)
    missed = missed_links(mixed_buckets(chain, first, signed), threshold)
    merged = components(missed).select(F.col("node").alias("old"), F.col("root").alias("new"))  # roots of the first round
    roots = first.join(merged, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
    roots = roots.unionByName(merged.select(F.col("old").alias("node"), F.col("new").alias("root")))
    discard(missed)
    discard(met)
    discard(signed)
    return written(members.join(roots, "node", "left").select("row_id", "doc_id", "text_key", F.coalesce("root", "node").alias("root")), "classes", few=True)


def carry_keys(sign):
    """`sign` over (row_id, text) of batches that also hold doc_id and text_key, which ride along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: list[pa.RecordBatch] = []

        def inner() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                carried.append(batch)
                yield batch.select(["row_id", "text"])

        for out in sign(inner()):
            batch = carried.pop()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), *out.columns], names=["doc_id", "text_key", *out.schema.names])

    return run


def classes(docs: DataFrame, **options) -> DataFrame:
    """doc_id and class_id, one row for each row of docs: class_id is the smallest doc_id of the class, null if it has none."""
    found = near_duplicates(docs, **options)
    heads = written(found.groupBy("root").agg(F.min("doc_id").alias("class_id")), "heads", few=True)  # a table, as `nodes` is
    return found.join(heads, "root").select("doc_id", "class_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """`docs` with one row of each class, unchanged: the smallest doc_id (null last), then the smallest hash of the text.

    Of rows alike in both, with other columns that differ, the one that reads smallest as JSON stays.
    """
    found = near_duplicates(docs, **options)
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    kept = written(found.groupBy("root").agg(F.min(rank).alias("r")).select(F.col("r.doc_id").alias("__doc_id"), F.col("r.text_key").alias("__kept_key")), "kept", few=True)
    key = F.unhex(F.md5(F.encode(F.coalesce(docs["text"], F.lit("")), "UTF-8")))
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), docs["doc_id"].cast("long").alias("__id"), key.alias("__text_key"))
    matched = keyed.join(kept, F.col("__id").eqNullSafe(F.col("__doc_id")) & (F.col("__text_key") == F.col("__kept_key")), "left_semi")
    repeated = found.groupBy("doc_id", "text_key").agg(F.count("*").alias("c")).where("c > 1")
    if not repeated.limit(1).isEmpty():
        matched = matched.groupBy("__id", "__text_key").agg(F.min_by("__row", F.to_json(F.struct("__row"))).alias("__row"))
    discard(found)
    return matched.select(*[F.col("__row")[c].alias(c) for c in docs.columns])
