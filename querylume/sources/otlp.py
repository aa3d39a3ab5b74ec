"""Events as log records with flat attributes, in chunks of bounded count and size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylume.sources.schema import COLUMNS, ENVELOPE

#: Attribute names that differ from column names (fixed values: the wire contract).
RENAMED = {"db_name": "db.name", "db_user": "db.user", "db_operation": "db.operation.name", "query_text": "db.query.text"}
SECONDS = "db.client.operation.duration"
RECORD_BYTES, ATTRIBUTE_BYTES = 64, 16


def records(events: DataFrame) -> DataFrame:
    """time_unix_nano, string_attributes, int_attributes, double_attributes and an estimate of the bytes.

    Integers that are 0 are left out; the duration is there twice, in seconds and in microseconds.
    """
    texts = [(RENAMED.get(n, n), n) for n, kind, *_ in COLUMNS if kind == "string" and n not in ENVELOPE]
    numbers = [(n, n) for n, kind, *_ in COLUMNS if kind in ("long", "int", "short")]
    strings = F.create_map(*[x for name, c in texts for x in (F.lit(name), F.coalesce(F.col(c), F.lit("")))])
    ints = F.map_filter(F.create_map(*[x for name, c in numbers for x in (F.lit(name), F.col(c).cast("long"))]), lambda k, v: v != 0)
    out = events.select(
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("time_unix_nano"),
        strings.alias("string_attributes"),
        ints.alias("int_attributes"),
        F.create_map(F.lit(SECONDS), F.col("duration_us") / 1e6).alias("double_attributes"),
    )
    names = F.aggregate(F.map_keys("int_attributes"), F.lit(0), lambda n, k: n + F.octet_length(k) + ATTRIBUTE_BYTES)
    values = F.aggregate(F.map_entries("string_attributes"), F.lit(0), lambda n, e: n + F.octet_length(e["key"]) + F.octet_length(e["value"]) + ATTRIBUTE_BYTES)
    return out.withColumn("bytes", F.lit(RECORD_BYTES + len(SECONDS) + ATTRIBUTE_BYTES) + names + values)


def as_json(events: DataFrame) -> DataFrame:
    """One JSON text a record, and its estimated bytes."""
    return records(events).select(F.to_json(F.struct("time_unix_nano", "string_attributes", "int_attributes", "double_attributes")).alias("value"), "bytes")


def requests(events: DataFrame, batch_size: int = 8192, max_bytes: int = 3 << 20) -> DataFrame:
    """records, bytes and value: JSON arrays of records, of at most `batch_size` records and `max_bytes` estimated bytes.

    A record over `max_bytes` is alone.  Each task cuts its own rows, so nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def request() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"records": [len(held)], "bytes": [size], "value": ["[" + ",".join(held) + "]"]})

        for batch in batches:
            for value, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (len(held) >= batch_size or size + n > max_bytes):
                    yield request()
                    held, size = [], 0
                held.append(value)
                size += n
        if held:
            yield request()

    return as_json(events).mapInArrow(run, "records long, bytes long, value string")
