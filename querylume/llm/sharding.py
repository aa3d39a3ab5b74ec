"""Two-pass external shuffle of records into shards, with DataFrame functions only.

Sizes decide how many memory-sized buckets a shard gets.  Pass one scatters: a seeded hash gives each record a
bucket of its shard, and the records are written with it, so that every later read, a retry's too, sees the
same buckets.  Pass two moves whole records to their buckets, collects each bucket in a canonical order, puts it through a
Fisher-Yates shuffle (Spark's own `shuffle`), and gives its records the slots that follow those of the buckets
before it.  `write_shards` writes the texts so placed; `digest` of what it wrote tells the contents apart.

The shard follows the `key` law: doc_id and the shard count alone decide it.  Each shard draws a seeded
hash for the id and the highest draw wins, so one more shard takes records only into itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written

#: Names that say where a record went, and its size.
PLACES = ("law", "shard", "slot", "grown_shard")
SIZE = "size"


def draw(key: Column, shard: int, seed: int) -> Column:
    return F.xxhash64(key, F.lit(shard), F.lit(seed))


def shard_of(key: Column, shards: int, seed: int) -> Column:
    best = F.greatest(*[draw(key, i, seed) for i in range(shards)]) if shards > 1 else draw(key, 0, seed)
    return reduce(lambda rest, i: F.when(draw(key, i, seed) == best, F.lit(i)).otherwise(rest), reversed(range(shards)), F.lit(0))


def grown_shard_of(key: Column, shards: int, seed: int) -> Column:
    """The shard once there is one more: the new one if its draw beats all others."""
    best = F.greatest(*[draw(key, i, seed) for i in range(shards)]) if shards > 1 else draw(key, 0, seed)
    return F.when(draw(key, shards, seed) > best, F.lit(shards)).otherwise(shard_of(key, shards, seed))


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, size and text_crc32, and the places that docs have: what shards can be compared by without their texts."""
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_size(docs["text"]).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), *[c for c in PLACES if c in docs.columns])


def named_apart(records: DataFrame, *taken: str) -> DataFrame:
    """`records` with columns of these names kept as `<name>_before`, or with more such endings until no name is taken twice."""
    names = list(records.columns)
    for i, name in enumerate(names):
        if name in taken:
            while name in (*taken, *names):
                name += "_before"
            names[i] = name
    return records.toDF(*names)


def external_shuffle(records: DataFrame, shards: int = 8, seed: int = 20240131, bucket_bytes: int = 16 << 20, bucket_rows: int = 4096) -> DataFrame:
    """`records` with shard, slot (gapless from 0 within its shard), grown_shard and law.

    `records` has doc_id and size; any other columns ride along, texts too; those named like one of PLACES get
    another name (see named_apart).  A bucket holds about
    `bucket_bytes` of `size` and at most about `bucket_rows` rows, whichever gives more buckets; its records
    are the most that is collected at once.  The bucket is drawn from the id, the size and the row's place in
    its partition, so equal rows, or one id with very many rows, spread over the buckets of their shard.  Null
    ids share one shard.  An empty table gives no rows.
    """
    return place(*scatter(named_apart(records, *PLACES), shards, seed, bucket_bytes, bucket_rows), shards, seed)


def scatter(records: DataFrame, shards: int, seed: int, bucket_bytes: int = 16 << 20, bucket_rows: int = 4096) -> tuple[DataFrame, int]:
    """Pass one: the written records with shard and bucket, numbered over all shards, and the number of buckets."""
    total = records.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    buckets = max(1, -(-total["bytes"] // (bucket_bytes * shards)), -(-total["n"] // (bucket_rows * shards)))
    drawn = records.select(
        shard_of(F.col("doc_id"), shards, seed).alias("shard"),
        F.pmod(F.xxhash64(F.col("doc_id"), F.col("size"), F.monotonically_increasing_id(), F.lit(seed)), F.lit(buckets)).alias("bucket"),
        F.struct(*records.columns).alias("record"),
    )
    scattered = drawn.withColumn("bucket", (F.col("bucket") * shards + F.col("shard")).cast("int"))
    return written(scattered, "scattered", compression="zstd"), buckets * shards


def place(rows: DataFrame, buckets: int, shards: int, seed: int) -> DataFrame:
    """Pass two.  One bucket goes to a task, and none is collected before it has moved.

    Partition b holds bucket b alone, sorted, and `shuffle` draws from its seed and the partition's number.  So a
    task that runs again, after an executor is lost, places the same records in the same slots.
    """
    carried = rows.schema["record"].dataType.names
    moved = rows.repartitionById(buckets, "bucket")
    gathered = moved.groupBy("bucket").agg(F.array_sort(F.collect_list("record")).alias("records"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_slot"))
    placed = gathered.join(F.broadcast(offsets), "bucket").select("shard", "first_slot", F.posexplode(F.shuffle("records", F.lit(seed))).alias("at", "record"))
    return placed.select(
        *[F.col("record")[c].alias(c) for c in carried],
        F.lit("key").alias("law"),
        F.col("shard"),
        (F.col("first_slot") + F.col("at")).alias("slot"),
        grown_shard_of(F.col("record")["doc_id"], shards, seed).alias("grown_shard"),
    )


def write_shards(records: DataFrame, path: str, shards: int = 8, seed: int = 20240131, **options) -> DataFrame:
    """Write whole records as Parquet, one directory a shard, each file in slot order; returns them as written.

    `size` is the text's; columns of `records` named like it or like one of PLACES get another name (see named_apart).
    """
    sized = named_apart(records, SIZE, *PLACES).withColumn(SIZE, text_size(F.col("text")))
    rows, buckets = scatter(sized, shards, seed, **options)
    out = place(rows, buckets, shards, seed)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(path)
    discard(rows)
    return records.sparkSession.read.schema(out.schema).parquet(path)
