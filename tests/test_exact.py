"""Quantiles and ingest over more rows than a sketch holds or one batch should."""

from datetime import datetime


from querylume.functions.ingest import cut_bytes
from querylume.functions.states import exact_quantiles
from querylume.operators import recipes as r
from querylume.operators.rollups import app_user_stats, query_stats
from querylume.plans import catalogue
from querylume.sources import arrow_ipc, tables
from querylume.sources.adapter import telemetry

NOW = datetime(2024, 1, 2)


def many_events(spark, n):
    """Durations 0 to n - 1, shuffled, of one query and application."""
    return spark.range(n).selectExpr(
        *("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id % 900) AS ts", "'i' AS instance_ubid", "'d' AS db_name", "'u' AS db_user", "'a' AS app", "1L AS query_id"),
        *("'SELECT' AS db_operation", f"id * 7919 % {n} AS duration_us", "id AS rows", "id AS shared_blks_hit", "id AS shared_blks_read", "0 AS err_elevel"),
    )


def test_top_by_p99_of_a_large_group_is_exact(spark):
    rollup, n = query_stats().by_value("duration_us"), 50_000
    got = r.top_by_p99(rollup.build(many_events(spark, n)), NOW, None, rollup=rollup, exact=True).first()
    assert (got["calls"], got["p95_ms"], got["p99_ms"]) == (n, 47.5, 49.5)  # the values at ranks 47,500 and 49,500, rounded


def test_load_by_app_of_a_large_group_is_exact(spark):
    rollup, n = app_user_stats().by_value("duration_us"), 50_000
    got = r.load_by_app(rollup.build(many_events(spark, n)), NOW, None, rollup=rollup, exact=True).first()
    assert (got["total_queries"], got["total_seconds"], got["p99_ms"], got["errors"]) == (n, 1249.98, 49.5, 0)  # 1249.975 rounded


def test_exact_quantiles_of_counted_values(spark):
    rows = spark.createDataFrame([("a", v, c) for v, c in ((1, 5), (2, 90), (2, 4), (9, 1))] + [(None, 3, 1), ("b", None, 7)], "k string, x long, n long")
    got = {row["k"]: row["q"] for row in exact_quantiles(rows, ["k"], "x", "n", 0.05, 0.95, 0.99, 1.0).collect()}
    assert got == {"a": [1, 2, 2, 9], None: [3, 3, 3, 3]}


def test_ingested_input_keeps_all_cores_busy(spark, small):
    sink = catalogue.ingested(spark, small)
    top = sink.path.removesuffix("/out")
    files = [c for c in tables.children(spark, f"{top}/in") if c.endswith(".parquet")]
    assert len(files) > spark.sparkContext.defaultParallelism
    assert len(tables.batches(spark, f"{sink.path}/events_raw")) == 2
    assert sink.events(spark).count() == 1000


def test_short_texts_are_cut_without_patterns(spark):
    """A short text stays as it is, even one whose last character ends in a byte that Java takes for a line end."""
    rows = spark.createDataFrame([("aÅ",), ("日本",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(cut_bytes("t", 4)).collect()] == ["aÅ", "日", "", None]


def test_scan_of_many_small_blocks(spark, small):
    """Wanted columns alone, gathered over blocks, are those of a scan of everything."""
    told = arrow_ipc.blocks(telemetry(spark, small), "arrow_ipc", 65536)
    assert told.count() > 5
    names = ["duration_us", "query_id", "instance_ubid"]
    some = arrow_ipc.scan(spark, told, names)
    assert sorted(some.columns) == sorted(names) and some.count() == 1000
    assert some.exceptAll(arrow_ipc.scan(spark, told).select(some.columns)).isEmpty()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").removesuffix("b")) <= arrow_ipc.AT_ONCE
