"""Helpers that the operators share: tables, written intermediate results, Arrow batches."""

from __future__ import annotations

import os
import pickle
import tempfile
import uuid
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the documents table, in its order.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_arrow_batches(spark: SparkSession, records: int = 2000, size: str = "16m") -> None:
    """Keep Arrow batches small enough for very long texts, unless the session already has smaller ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > records:
        spark.conf.set(key, str(records))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    except Exception as error:  # only a Spark without this setting may refuse it
        if "arrow.maxBytesPerBatch" not in str(error):
            raise


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where it is unset, Spark in one process (local mode) takes a temporary folder; a cluster has none to take.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "querylume-checkpoints")
    return found.rstrip("/")


def written(df: DataFrame, name: str, few: bool = False, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder: the lineage is cut, and a lost executor costs only a re-read.

    With `few` the partitions are written by four tasks a core at most, so that many small ones make few files:
    on a local disk each file that is begun starts a process, which seems to hold the executor's memory once
    more until it runs.  `options` are the writer's.
    """
    spark = df.sparkSession
    if few:
        df = df.coalesce(4 * spark.sparkContext.defaultParallelism)
    path = f"{shared_dir(spark)}/querylume-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path  # type: ignore[attr-defined]
    return out


def discard(df: DataFrame | None) -> None:
    """Delete what written() wrote, once nothing reads it any more."""
    path = getattr(df, "_written_path", None)
    if path is None:
        return
    sc = df.sparkSession.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


class Shared:
    """A broadcast value whose classes travel with it, as the functions that read it do."""

    def __init__(self, spark: SparkSession, value: Any):
        self.packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self) -> Any:
        """Unpacked once in each task."""
        if "unpacked" not in self.__dict__:
            self.unpacked = pickle.loads(self.packed.value)
        return self.unpacked


def is_held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32(doc_id as text) mod modulus = remainder; rows without an id are never held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % modulus == remainder, F.lit(False))


def raw_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, b'' for null."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def batch_of(schema: pa.Schema, columns: dict[str, Any]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def word_table() -> bytes:
    """For bytes.translate: A-Z become a-z, digits and all non-ASCII bytes stay, the rest become spaces.

    After it, bytes.split() gives the words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the lower-cased text.
    """
    keep = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(128, 256))
    return bytes(c if c in keep else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


WORDS = word_table()
