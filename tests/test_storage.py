import json
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from querylume.config import Config
from querylume.operators import recipes
from querylume.operators.rollups import REGISTERED, query_stats, register_rollup
from querylume.functions.states import count_state
from querylume.sources import arrow_ipc, otlp, tables
from querylume.sources.adapter import telemetry
from querylume.sources.schema import conform
from querylume.streaming import ingest

NOW = datetime(2024, 1, 31)


@pytest.fixture(scope="module")
def events(spark, small):
    return conform(telemetry(spark, small))


def test_table_round_trip_and_retention(spark, events, tmp_path):
    path = f"file://{tmp_path}/events"
    tables.append_events(events, path)
    back = tables.read_events(spark, path)
    assert back.count() == 1000
    assert back.drop("event_date").exceptAll(events).isEmpty()
    day = recipes.lookback(back, NOW, timedelta(days=1))
    assert "PartitionFilters: [isnotnull(event_date" in day._jdf.queryExecution().executedPlan().toString()
    dropped = tables.retain(spark, path, NOW, days=10)
    assert len(dropped) == 20 and tables.read_events(spark, path).count() < 1000
    tables.truncate(spark, path)
    assert tables.children(spark, path) == []


def test_rollup_answers_like_raw(events):
    stored = query_stats().build(events)
    twice = query_stats().compact(stored.unionByName(query_stats().build(events.limit(0))))
    a = recipes.top_by_p99(twice, None, None, rollup=query_stats()).collect()
    assert a == recipes.top_by_p99_raw(events, None, None, exact=True).collect()


def test_arrow_shapes(spark, events):
    first = pa.ipc.open_stream(arrow_ipc.blocks(events.limit(5), "arrow_ipc").first()["block"]).read_all()
    assert len(first.schema) == 56 and first.schema.field("ts").type == pa.timestamp("ns", "UTC")
    assert first.schema.field("duration_us").type == pa.uint64() and first.schema.field("query_id").type == arrow_ipc.LOW
    unified = pa.ipc.open_stream(arrow_ipc.blocks(events.limit(5)).first()["block"]).read_all()
    assert len(unified.schema) == 52 and unified.schema.field("err_elevel").type == pa.uint8()


@pytest.mark.parametrize("shape", ["arrow_ipc", "arrow_events_raw"])
def test_arrow_round_trip(spark, events, shape):
    rows = events.withColumn("query_id", F.col("query_id") * -1)
    blocks = arrow_ipc.blocks(rows, shape, 65536)
    assert blocks.agg(F.sum("block_rows")).first()[0] == 1000 and blocks.count() > 1
    back = arrow_ipc.scan(spark, blocks)
    assert back.exceptAll(rows).isEmpty() and rows.exceptAll(back).isEmpty()


def test_log_records(events):
    row = otlp.records(events.orderBy("ts").limit(1)).first()
    assert 0 not in row["int_attributes"].values() and "db.query.text" in row["string_attributes"]
    for batch_size, max_bytes in ((100, 1 << 20), (5000, 20_000), (5000, 1)):
        found = otlp.requests(events, batch_size, max_bytes).collect()
        assert sum(r["records"] for r in found) == 1000 == sum(len(json.loads(r["value"])) for r in found)
        assert all(r["records"] <= batch_size and (r["bytes"] <= max_bytes or r["records"] == 1) for r in found)


def test_stream_equals_batch(spark, events, tmp_path):
    source, top = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    register_rollup("by_app", ("app",), (count_state(),)) if "by_app" not in REGISTERED else None
    events.repartition(3).write.parquet(source)
    sink, counters = ingest.TableSink(top), ingest.Counters()
    config = Config(log_min_elevel="debug5")
    run = lambda: ingest.start(ingest.file_source(spark, source, 1), sink, f"file://{tmp_path}/check", config, counters, drain=True).awaitTermination()
    run()
    assert sink.events(spark).count() == 1000 == counters.exported == counters.enqueued
    merged = recipes.top_by_p99(sink.states(spark, "query_stats_5m"), None, None, rollup=query_stats())
    assert merged.select("query_id", "calls").count() == 10
    assert sink.states(spark, "query_stats_5m").agg(F.sum("calls_state")).first()[0] == 1000
    late = events.limit(7).withColumn("ts", F.lit("2023-12-01 00:00:00").cast("timestamp"))
    late.write.mode("append").parquet(source)
    run()
    assert sink.events(spark).count() == 1007
    sink.compact(spark, "query_stats_5m", 10)
    assert sink.states(spark, "query_stats_5m").agg(F.sum("calls_state")).first()[0] == 1007
    sink.compact(spark, "events_raw", 10)
    sink.write(events.limit(7), 0)  # a batch that has been compacted is not written again
    assert sink.states(spark, "query_stats_5m").agg(F.sum("calls_state")).first()[0] == 1007
    assert sink.events(spark).count() == 1007 and tables.children(spark, f"{top}/events_raw") == ["_compacted-10"]
    assert sink.texts(spark).count() == events.where("query_text <> ''").select("query_id").distinct().count()
    dropped = sink.retain(spark, NOW, days=10, state_days=10)
    assert dropped and sink.events(spark).where(F.col("ts") < "2024-01-21").isEmpty() and not sink.events(spark).isEmpty()
    assert sink.states(spark, "query_stats_5m").where(F.col("bucket") < "2024-01-21").isEmpty()
    stats = counters.stats(spark).first()
    assert stats["queue_size"] <= stats["queue_capacity"] and stats["last_error_ts"] is None


def test_retention_of_uncompacted_batches(spark, events, tmp_path):
    sink = ingest.TableSink(f"file://{tmp_path}/t")
    sink.write(events, 0)
    assert len(sink.retain(spark, NOW, days=10)) == 20
    assert sink.events(spark).where(F.col("ts") < "2024-01-21").isEmpty() and sink.events(spark).count() > 0
    tables.truncate(spark, f"{sink.path}/events_raw")
    assert tables.children(spark, f"{sink.path}/events_raw") == []


def test_first_batch_again_after_its_compaction(spark, events, tmp_path):
    sink = ingest.TableSink(f"file://{tmp_path}/t")
    sink.write(events.limit(20), 0)
    for name in ("events_raw", "query_texts", *sink.rollups):
        sink.compact(spark, name, 0)
    sink.write(events.limit(20), 0)
    assert sink.events(spark).count() == 20
    assert sink.states(spark, "query_stats_5m").agg(F.sum("calls_state")).first()[0] == 20
    assert tables.children(spark, f"{sink.path}/events_raw") == ["_compacted-0"]


@pytest.mark.parametrize("stop", ["before the end of writing", "before the old ones go", "while they go"])
def test_compaction_that_stops_midway(spark, events, tmp_path, monkeypatch, stop):
    sink = ingest.TableSink(f"file://{tmp_path}/t")
    for i in range(3):
        sink.write(events.where(F.col("pid") % 3 == i), i)
    whole = lambda: (sink.events(spark).count(), sink.states(spark, "query_stats_5m").agg(F.sum("calls_state")).first()[0])
    deleted = []

    def delete(spark, path, real=tables.delete):
        if stop == "before the old ones go" or deleted:
            raise OSError("stopped")
        deleted.append(path)
        real(spark, path)

    for name in ("events_raw", "query_stats_5m"):
        deleted.clear()
        with monkeypatch.context() as patch:
            patch.setattr(tables, "delete", delete)
            with pytest.raises(OSError):
                if stop == "before the end of writing":
                    patch.setattr(tables, "append_states", lambda *a, **k: (_ for _ in ()).throw(OSError("stopped")))
                    patch.setattr(tables, "append_events", lambda *a, **k: (_ for _ in ()).throw(OSError("stopped")))
                sink.compact(spark, name, 1)
        assert whole() == (1000, 1000)
    sink.write(events.where(F.col("pid") % 3 == 2), 2)  # tried again
    for name in ("events_raw", "query_stats_5m"):
        sink.compact(spark, name, 1)
        sink.compact(spark, name, 2)
        assert tables.children(spark, f"{sink.path}/{name}") == ["_compacted-2"]
    assert whole() == (1000, 1000)


def test_ingest_as_one_path(spark, events, tmp_path):
    """Filter, masking, lookup, envelope, bounds, counters and dump, through a stream of two batches."""
    top = f"file://{tmp_path}"
    sent = events.limit(50).withColumns({"query_text": F.lit("SELECT 'secret', 5"), "query_id": F.lit(7).cast("long"), "tag": F.lit(None).cast("string"), "is_parallel_worker": F.lit(None).cast("boolean"), "region": F.lit(""), "client_addr": F.lit("[local]")})
    utility = sent.limit(4).withColumn("tag", F.element_at(F.array(F.lit("BEGIN"), F.lit("COPY")), (F.col("pid") % 2 + 1).cast("int")))
    worker, undated = sent.limit(3).withColumn("is_parallel_worker", F.lit(True)), sent.limit(2).withColumn("ts", F.lit(None).cast("timestamp"))
    copies = utility.where("tag = 'COPY'").count()
    sent.unionByName(utility).unionByName(worker).unionByName(undated).coalesce(1).write.parquet(f"{top}/in")
    config = Config(log_min_elevel="debug5", extra_attributes="region:r9;cell:c1", hostname="box", batch_max=20, debug_arrow_dump_dir=f"{top}/dump")
    sink, counters = ingest.sink_for(config, f"{top}/out"), ingest.Counters()
    run = lambda: ingest.start(ingest.file_source(spark, f"{top}/in", 1), sink, f"{top}/check", config, counters, drain=True, texts=lambda s: sink.texts(s) if tables.exists(s, f"{top}/out/query_texts") else s.createDataFrame([], "query_id long, query_text string")).awaitTermination()
    run()
    got = sink.events(spark)
    assert got.count() == 50 + copies == counters.exported and counters.dropped == 2 and counters.text_losses == 0
    assert {tuple(r) for r in got.select("query_text", "region", "cell", "host_id", "client_addr").distinct().collect()} == {("SELECT $1, $2", "r9", "c1", "box", "127.0.0.1")} or got.select("host_id").distinct().count() > 1
    assert tables.parts(got).agg(F.max("n")).first()[0] <= 20
    bare = sent.limit(6).withColumn("query_text", F.lit("")).withColumn("query_id", F.when(F.col("pid") % 2 == 0, 7).otherwise(8).cast("long"))
    known = bare.where("query_id = 7").count()
    bare.write.mode("append").parquet(f"{top}/in")
    run()
    assert counters.text_losses == 6 - known and sink.events(spark).where("query_text = 'SELECT $1, $2'").count() == 50 + copies + known
    dumped = arrow_ipc.scan(spark, spark.read.parquet(f"{top}/dump/batch_id=0"))
    assert dumped.count() == 50 + copies
    logs = ingest.sink_for(Config(use_otel=True, otel_log_batch_size=10), f"{top}/logs")
    logs.write(sink.events(spark).drop("event_date"), 0)
    assert all(len(json.loads(r["value"])) <= 10 for r in spark.read.text(f"{top}/logs").collect())
    status = recipes.health(counters.stats(spark), ingest.version()).first()["status"]
    assert status == "DROPS DETECTED"


def test_default_sketches_are_within_a_rank_error(spark):
    """Groups of 40,000 rows outgrow k = 4096; quantiles of merged partial states are near in rank, not equal."""
    rows = spark.range(80_000).selectExpr("'i' AS instance_ubid", "'d' AS db_name", "id % 2 AS query_id", "'S' AS db_operation", "TIMESTAMP '2024-01-01 00:00:01' AS ts", "(id * 7919) % 80000 AS duration_us", "1L AS rows", "1L AS shared_blks_hit", "1L AS shared_blks_read")
    states = query_stats().build(rows.where("id % 3 = 0")).unionByName(query_stats().build(rows.where("id % 3 > 0")))
    for r in query_stats().merge(states, ("query_id",)).select(F.expr("kll_sketch_get_quantile_bigint(duration_q_state, array(0.5D, 0.95D, 0.99D))").alias("q")).collect():
        for got, p in zip(r["q"], (0.5, 0.95, 0.99), strict=True):
            assert abs(got / 80_000 - p) < 0.005
    exact = rows.agg(F.countDistinct("duration_us")).first()[0]
    assert abs(rows.agg(F.approx_count_distinct("duration_us")).first()[0] - exact) < 0.15 * exact
    near = rows.agg(F.percentile_approx("duration_us", F.lit(0.95))).first()[0]
    assert abs(near / 80_000 - 0.95) < 0.005


def test_failing_sink_is_tried_again(spark, events, tmp_path):
    source = f"file://{tmp_path}/in"
    events.limit(10).write.parquet(source)
    calls, waits = [], []

    class Flaky:
        def write(self, batch, batch_id):
            calls.append(batch.count())
            if len(calls) < 3:
                raise OSError("store is away")

    counters = ingest.Counters()
    ingest.start(ingest.file_source(spark, source), Flaky(), f"file://{tmp_path}/check", counters=counters, drain=True, sleep=waits.append).awaitTermination()
    assert len(calls) == 3 and waits == [1.0, 2.0] and counters.failures == 2 and counters.consecutive == 0
    counters.reset()
    assert counters.exported == 0
    assert [ingest.retry_delay_ms(n) for n in (0, 1, 7, 50)] == [500, 1000, 60000, 60000]


def test_health(spark):
    counters = ingest.Counters()
    status = lambda: recipes.health(counters.stats(spark), ingest.version()).first()["status"]
    assert status() == "NO EVENTS"
    counters.enqueued = 5
    assert status() == "OK"
    counters.queue_size = 120000
    assert status() == "QUEUE PRESSURE"
    counters.dropped = 1
    assert status() == "DROPS DETECTED"
    counters.failures = 1
    assert status() == "EXPORT ERRORS"
