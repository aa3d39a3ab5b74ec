"""Event and state tables as Parquet folders, partitioned by day and sorted within."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querylume.sources.schema import EVENTS

#: The declared columns and the partition column.
DATED = T.StructType([*EVENTS.fields, T.StructField("event_date", T.DateType())])


def filesystem(spark: SparkSession, path: str):
    """The file system of a path and the path as it knows it; works for any store that Spark reaches."""
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(sc._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = filesystem(spark, path)
    return fs.exists(target)


def children(spark: SparkSession, path: str) -> list[str]:
    fs, target = filesystem(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, target = filesystem(spark, path)
    fs.delete(target, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, or, in local mode only, below the temporary folder where that is unset."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = f"file://{tempfile.gettempdir()}/querylume-checkpoints"
    return f"{top.rstrip('/')}/querylume-{name}-{uuid.uuid4().hex}"


def append_events(events: DataFrame, path: str, mode: str = "append", most_rows: int = 0) -> None:
    """Rows sorted by (instance_ubid, ts) within each file, in a folder for each day; `most_rows` bounds a file's rows.

    Rows are dealt by day, so that a small batch makes a file a day; Spark splits days that are large.
    """
    dated = events.withColumn("event_date", F.to_date("ts")).hint("rebalance", "event_date")
    sorted_rows = dated.sortWithinPartitions("event_date", "instance_ubid", "ts")
    sorted_rows.write.mode(mode).partitionBy("event_date").options(compression="zstd", maxRecordsPerFile=most_rows).parquet(path)


def append_states(states: DataFrame, path: str, mode: str = "append") -> None:
    dated = states.withColumn("bucket_date", F.to_date("bucket")).hint("rebalance", "bucket_date")
    dated.write.mode(mode).partitionBy("bucket_date").option("compression", "zstd").parquet(path)


def batches(spark: SparkSession, path: str) -> dict[int, str]:
    """Folders of a table's batches that are not part of its compacted folder yet, by number."""
    upto = compacted_upto(spark, path)
    found = {int(c.partition("=")[2]): f"{path}/{c}" for c in children(spark, path) if c.startswith("batch_id=")}
    return {n: folder for n, folder in sorted(found.items()) if upto is None or n > upto}


def compacted(path: str, upto: int) -> str:
    """Where batches up to a number are merged; the name keeps it from being read as a batch."""
    return f"{path}/_compacted-{upto}"


def compacted_upto(spark: SparkSession, path: str) -> int | None:
    """The number of the last compaction that was written to its end, which its _SUCCESS file tells."""
    numbers = [int(c.rpartition("-")[2]) for c in children(spark, path) if c.startswith("_compacted-")]
    whole = [n for n in numbers if exists(spark, f"{compacted(path, n)}/_SUCCESS")]
    return max(whole, default=None)


def live(spark: SparkSession, path: str, schema: T.StructType | None, upto: int | None = None) -> DataFrame:
    """The rows of a table: its compacted folder and the batches after it (up to a number), or the whole folder if it has no batches."""
    reader = lambda: spark.read.schema(schema) if schema else spark.read
    done = compacted_upto(spark, path)
    found = [folder for n, folder in batches(spark, path).items() if upto is None or n <= upto]
    if done is None and not found:
        return reader().parquet(path)
    out = [reader().parquet(compacted(path, done))] if done is not None else []
    if found:
        out.append(reader().option("basePath", path).parquet(*found).drop("batch_id"))
    return reduce(DataFrame.unionByName, out)


def compact(spark: SparkSession, path: str, upto: int, merge: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, str], None], schema: T.StructType | None = None) -> None:
    """Batches up to a number, and what was compacted before, as one folder.

    The new folder counts from the moment its _SUCCESS file is there, and the old ones no longer; only then do
    they go.  So a crash at any point, or a reader that comes between, finds every row once.
    """
    old = {n: f for n, f in batches(spark, path).items() if n <= upto}
    done = compacted_upto(spark, path)
    if old and (done is None or done < upto):
        write(merge(live(spark, path, schema, upto)), compacted(path, upto))
    done = compacted_upto(spark, path)
    for c in children(spark, path):
        number = int(c.rpartition("-")[2]) if c.startswith("_compacted-") else int(c.partition("=")[2]) if c.startswith("batch_id=") else None
        if done is not None and number is not None and (number < done or c.startswith("batch_id=") and number == done):
            delete(spark, f"{path}/{c}")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The declared schema, never an inferred one, and the partition column event_date."""
    return live(spark, path, DATED)


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """S11."""
    return live(spark, path, None)


def truncate(spark: SparkSession, path: str) -> None:
    """The table's rows go; its folder stays."""
    for name in children(spark, path):
        delete(spark, f"{path}/{name}")


def drop_before(spark: SparkSession, path: str, before: date, column: str = "event_date") -> list[str]:
    """Retention: whole days before a date go, in batches and compacted folders too.  Returns the dropped folders."""
    inner = [c for c in children(spark, path) if c.startswith(("batch_id=", "_compacted-"))]
    days = [c for c in children(spark, path) if c.startswith(f"{column}=")] + [f"{top}/{c}" for top in inner for c in children(spark, f"{path}/{top}") if c.startswith(f"{column}=")]
    old = [d for d in days if d.rpartition("=")[2] < before.isoformat()]
    for name in old:
        delete(spark, f"{path}/{name}")
    return old


def retain(spark: SparkSession, path: str, now: datetime, days: int = 180, column: str = "event_date") -> list[str]:
    return drop_before(spark, path, (now - timedelta(days=days)).date(), column)


def columns(df: DataFrame) -> DataFrame:
    """Names and types, as a table."""
    return df.sparkSession.createDataFrame(df.dtypes, "name string, type string")


def parts(df: DataFrame) -> DataFrame:
    """Rows in each stored file."""
    return df.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n"))


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    """Tab-separated text, with or without names."""
    df.write.csv(path, sep="\t", header=header)


def pretty(df: DataFrame, n: int = 20) -> str:
    """The first rows as a boxed table; for looking, so it fetches n rows only."""
    return df._jdf.showString(n, 120, False)
