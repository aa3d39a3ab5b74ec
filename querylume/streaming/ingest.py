"""Streaming ingest: each micro-batch becomes rows of the event table and partial states of every rollup.

There is no watermark: a late row only adds a state row to its old bucket.  A batch writes its own folder in
each table, overwriting it if the batch is tried again, so a retry after a crash adds nothing twice; a batch that
has been compacted is not written again.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from querylume import __version__
from querylume.config import Config
from querylume.functions.ingest import attributes, cut_texts, filled, interned, level_filter, local_address, sampled, statement_filter
from querylume.functions.normalize import normalized
from querylume.operators.rollups import REGISTERED, Rollup, errors_recent
from querylume.sources import arrow_ipc, otlp, tables
from querylume.sources.schema import EVENTS, conform


class Sink(Protocol):
    def write(self, batch: DataFrame, batch_id: int) -> None: ...


def version() -> str:
    return __version__


@dataclass
class Counters:
    """What stats() reports; on the driver, a handful of numbers."""

    enqueued: int = 0
    dropped: int = 0
    exported: int = 0
    failures: int = 0
    consecutive: int = 0
    last_success: datetime | None = None
    last_error: datetime | None = None
    last_error_text: str | None = None
    queue_size: int = 0
    text_losses: int = 0

    def stats(self, spark: SparkSession, capacity: int = Config.queue_capacity) -> DataFrame:
        """One row of eleven columns; times and the error text are null until there is one."""
        row = (self.enqueued, self.dropped, self.exported, self.failures, self.last_success, self.last_error_text, self.last_error, self.queue_size, capacity, 100.0 * self.queue_size / capacity, self.text_losses)
        shape = "enqueued_events long, dropped_events long, exported_events long, send_failures long, last_success_ts timestamp, last_error_text string, last_error_ts timestamp, queue_size int, queue_capacity int, queue_usage_pct double, dsa_oom_count long"
        return spark.createDataFrame([row], shape)

    def reset(self) -> None:
        """Counters go back to zero; what waits in the source is untouched."""
        self.enqueued = self.dropped = self.exported = self.failures = self.consecutive = self.text_losses = 0
        self.last_success = self.last_error = self.last_error_text = None


def retry_delay_ms(failures: int, interval_ms: int = 500) -> int:
    """Doubling from a second with each failure in a row, a minute at most, and never under the interval."""
    backoff = min(1000 * 2 ** (min(failures, 10) - 1), 60000) if failures > 0 else 0
    return max(interval_ms, backoff)


@dataclass
class TableSink:
    """Under `path`: the event table events_raw, its distinct texts query_texts, and a table of states for each rollup.

    A file of events holds at most `most_rows` rows.
    """

    path: str
    rollups: dict[str, Rollup] = field(default_factory=lambda: REGISTERED)
    most_rows: int = Config.batch_max

    def write(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        table = lambda name: f"{self.path}/{name}"
        done = {name: tables.compacted_upto(spark, table(name)) for name in ("events_raw", "query_texts", *self.rollups)}
        new = lambda name: done[name] is None or done[name] < batch_id
        if new("events_raw"):
            tables.append_events(batch, f"{table('events_raw')}/batch_id={batch_id}", mode="overwrite", most_rows=self.most_rows)
        if new("query_texts"):
            interned(batch).write.mode("overwrite").parquet(f"{table('query_texts')}/batch_id={batch_id}")
        for name, rollup in self.rollups.items():
            if new(name):
                tables.append_states(rollup.build(batch), f"{table(name)}/batch_id={batch_id}", mode="overwrite")

    def events(self, spark: SparkSession) -> DataFrame:
        return tables.read_events(spark, f"{self.path}/events_raw")

    def errors(self, spark: SparkSession, now: datetime | None = None) -> DataFrame:
        return errors_recent(self.events(spark), now)

    def texts(self, spark: SparkSession) -> DataFrame:
        """One text a query id, for events that come without; of several, the first in their order."""
        rows = tables.live(spark, f"{self.path}/query_texts", None)
        return rows.groupBy("query_id").agg(F.min("query_text").alias("query_text"))

    def states(self, spark: SparkSession, name: str) -> DataFrame:
        return tables.read_states(spark, f"{self.path}/{name}")

    def compact(self, spark: SparkSession, name: str, upto: int) -> None:
        """Merge batches up to a number: states of one bucket and key, equal texts, or the small files of events."""
        folder, write = f"{self.path}/{name}", tables.append_states
        if name == "events_raw":
            # dealt by day and time, so that a day is a few files and Spark chooses how many
            dealt = lambda rows: rows.repartitionByRange("event_date", "ts").drop("event_date")
            tables.compact(spark, folder, upto, dealt, lambda rows, path: tables.append_events(rows, path, "overwrite"), tables.DATED)
        elif name == "query_texts":
            tables.compact(spark, folder, upto, DataFrame.distinct, lambda rows, path: rows.write.mode("overwrite").parquet(path))
        else:
            tables.compact(spark, folder, upto, lambda rows: self.rollups[name].compact(rows.drop("bucket_date")), lambda rows, path: write(rows, path, "overwrite"))

    def retain(self, spark: SparkSession, now: datetime, days: int = 180, state_days: int | None = None) -> list[str]:
        """Drop days of events, and of states if told to, that are older than so many days."""
        out = tables.retain(spark, f"{self.path}/events_raw", now, days)
        for name in self.rollups if state_days is not None else ():
            out += tables.retain(spark, f"{self.path}/{name}", now, state_days, "bucket_date")
        return out


@dataclass
class ArrowSink:
    """Blocks of Arrow IPC, one Parquet folder a batch."""

    path: str
    block_format: str = "arrow_events_raw"
    max_block_bytes: int = Config.otel_max_block_bytes

    def write(self, batch: DataFrame, batch_id: int) -> None:
        arrow_ipc.blocks(batch, self.block_format, self.max_block_bytes).write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")


@dataclass
class LogSink:
    """Requests of log records, a JSON array a line, one folder a batch."""

    path: str
    batch_size: int = Config.otel_log_batch_size
    max_bytes: int = Config.otel_log_max_bytes

    def write(self, batch: DataFrame, batch_id: int) -> None:
        otlp.requests(batch, self.batch_size, self.max_bytes).select("value").write.mode("overwrite").text(f"{self.path}/batch_id={batch_id}")


def sink_for(config: Config, path: str) -> Sink:
    if config.sink == "otlp":
        return LogSink(path, config.otel_log_batch_size, config.otel_log_max_bytes)
    if config.sink == "table":
        return TableSink(path, most_rows=config.batch_max)
    return ArrowSink(path, "arrow_events_raw" if config.sink == "unified_arrow" else "arrow_ipc", config.otel_max_block_bytes)


#: Columns that a source may have besides those of the event table: a utility statement's tag, and who sent it.
CAPTURED = T.StructType([T.StructField("tag", T.StringType()), T.StructField("is_parallel_worker", T.BooleanType())])


def file_source(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of event files with the declared schema and the columns of CAPTURED (null where a file lacks them)."""
    reader = spark.readStream.schema(T.StructType([*EVENTS.fields, *CAPTURED.fields]))
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def prepared(events: DataFrame, config: Config, texts: DataFrame | None = None) -> DataFrame:
    """What becomes of events, in the order in which capture does it.

    Wrapping statements and parallel workers' events go, then messages under the level, then what is not sampled.
    Literals of texts become parameters.  Events without a text take the one of their query id from `texts`.
    The settings' extra_attributes and hostname fill the envelope; columns are conformed and cut.
    """
    rows = events.where(F.lit(config.enabled))
    if "tag" in rows.columns:
        rows = statement_filter(rows)
    rows = sampled(level_filter(rows, config.log_min_elevel), config.min_duration_us, config.sample_rate, key="event_id" if "event_id" in events.columns else events.columns)
    rows = normalized(rows) if "query_text" in rows.columns else rows.withColumn("query_text", F.lit(""))
    if texts is not None:
        known = texts.select(F.col("query_id").alias("known_id"), F.col("query_text").alias("known_text"))
        rows = rows.join(known, F.col("query_id") == F.col("known_id"), "left").withColumn("query_text", F.coalesce(F.when(F.col("query_text") != "", F.col("query_text")), "known_text", F.lit(""))).drop("known_id", "known_text")
    rows = conform(filled(rows, {"host_id": config.hostname} | attributes(config.extra_attributes)))
    return cut_texts(rows.withColumn("client_addr", local_address(F.col("client_addr"))))


def start(
    events: DataFrame,
    sink: Sink,
    checkpoint: str,
    config: Config | None = None,
    counters: Counters | None = None,
    drain: bool = False,
    attempts: int = 3,
    sleep: Callable[[float], None] = time.sleep,
    texts: Callable[[SparkSession], DataFrame] | None = None,
) -> StreamingQuery:
    """Run ingest.  `texts` gives the table of texts by query id as it is at each batch, such as TableSink.texts.  `drain` takes what is there, batch by batch, and stops; otherwise it polls.

    A batch whose write fails is tried again, `attempts` times in all, with growing delays, then fails the
    query; started again from its checkpoint it takes up the same batch, so nothing is lost.
    """
    config, counters = config or Config(), counters or Counters()

    def write(batch: DataFrame, batch_id: int) -> None:
        every = prepared(batch, config, texts(batch.sparkSession) if texts else None).persist()
        rows = every.where(F.col("ts").isNotNull())
        try:
            told = every.agg(F.count("ts").alias("n"), F.count("*").alias("all"), F.count_if(F.expr("ts IS NOT NULL AND query_id <> 0 AND query_text = ''")).alias("lost")).first()
            n = told["n"]
            counters.enqueued += n
            counters.dropped += told["all"] - n  # no row of the table can be without a time
            counters.text_losses += told["lost"]
            if config.debug_arrow_dump_dir:
                arrow_ipc.dump(rows, f"{config.debug_arrow_dump_dir}/batch_id={batch_id}", max_block_bytes=config.otel_max_block_bytes)
            counters.queue_size = n
            for attempt in range(1, attempts + 1):
                try:
                    sink.write(rows, batch_id)
                    break
                except Exception as error:
                    counters.failures += 1
                    counters.consecutive += 1
                    counters.last_error, counters.last_error_text = datetime.now(timezone.utc), str(error)[:255]
                    if attempt == attempts:
                        raise
                    sleep(retry_delay_ms(counters.consecutive, config.flush_interval_ms) / 1000)
            counters.exported += n
            counters.queue_size, counters.consecutive = 0, 0
            counters.last_success = datetime.now(timezone.utc)
        finally:
            every.unpersist()

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=f"{config.flush_interval_ms} milliseconds")).start()


def flush(query: StreamingQuery) -> None:
    """Wait until everything that has arrived is written."""
    query.processAllAvailable()
