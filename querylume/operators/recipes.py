"""Ready-made analyses, each a function of event or rollup DataFrames.

`now` is always an argument; None means the full range.  `exact` asks for exact quantiles, exact distinct
counts and the smallest sample instead of any, for comparison with other engines; the default takes the
approximate forms, which need one pass and bounded memory for each group.  Every order that a limit cuts
ends in the group's key, or in event_id where rows have one, so results are stable.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylume.functions.buckets import bucket, lookback
from querylume.functions.states import exact_quantiles, quantiles
from querylume.operators.rollups import Rollup, app_user_stats, events_recent, query_stats
from querylume.sources.schema import ERROR

HOUR, DAY = timedelta(hours=1), timedelta(days=1)
Span = timedelta | None


# -- pieces ---------------------------------------------------------------------------------------------


def ms(us: Column) -> Column:
    return F.round(us / 1000, 2)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(100 * part / whole, digits)


def quantile(x: str, q: float, exact: bool) -> Column:
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {x})") if exact else F.percentile_approx(x, q)


def distinct(x: str, exact: bool) -> Column:
    return F.count_distinct(x) if exact else F.approx_count_distinct(x)


def sample(x: Column | str, exact: bool) -> Column:
    return F.min(x) if exact else F.any_value(x)


def preview(n: int, x: str = "query_text") -> Column:
    return F.substring(x, 1, n)


def top(df: DataFrame, n: int | None, *order: Column | str) -> DataFrame:
    """The first n rows; event_id breaks ties where there is one, and is then dropped."""
    tie = ["event_id"] if "event_id" in df.columns else []
    out = df.orderBy(*order, *tie)
    return (out if n is None else out.limit(n)).drop("event_id")


def keep_id(df: DataFrame) -> list[str]:
    return [c for c in ("event_id",) if c in df.columns]


# -- latency and load -----------------------------------------------------------------------------------


def slowest_of_app(events: DataFrame, app: str, now: datetime | None, span: Span = HOUR, n: int = 10, exact: bool = False) -> DataFrame:
    """R01."""
    rows = lookback(events, now, span).where(F.col("app") == app)
    out = rows.groupBy("query_id").agg(
        F.count("*").alias("calls"), (quantile("duration_us", 0.95, exact) / 1000).alias("p95_ms"), (quantile("duration_us", 0.99, exact) / 1000).alias("p99_ms")
    )
    return top(out, n, F.desc("p99_ms"), "query_id")


def recent_events(events: DataFrame, now: datetime | None, span: Span = timedelta(minutes=5), n: int = 50, detailed: bool = False) -> DataFrame:
    """R02; `detailed` adds operation and rows."""
    rows = lookback(events_recent(events, now, max(span, HOUR) if span else None), now, span)
    more = ["db_operation", "rows"] if detailed else []
    return top(rows.select("ts", "db_name", *more, (F.col("duration_us") / 1000).alias("ms"), preview(100).alias("query_preview"), *keep_id(rows)), n, F.desc("ts"))


def merged_quantiles(stored: DataFrame, rollup: Rollup, by: list[str], states: tuple[str, ...], exact: bool) -> DataFrame:
    """Merged states and q, the duration's quantiles 0.95 and 0.99; `exact` needs a rollup's by_value("duration_us")."""
    if not exact:
        return rollup.merge(stored, by, (*states, "duration_q_state")).withColumn("q", quantiles("duration_q_state", 0.95, 0.99))
    read = exact_quantiles(stored, by, "duration_us", "calls_state", 0.95, 0.99)
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in by]
    return rollup.merge(stored, by, states).join(read.withColumnsRenamed({c: f"of_{c}" for c in by}), same, "left")


def top_by_p99(stored: DataFrame, now: datetime | None, span: Span = HOUR, n: int = 10, rollup: Rollup | None = None, exact: bool = False) -> DataFrame:
    """R03, from the five-minute rollup."""
    rows = lookback(stored, now, span, "bucket", inclusive=True)
    read = merged_quantiles(rows, rollup or query_stats(), ["query_id", "db_operation"], ("calls_state", "duration_sum_state"), exact)
    out = read.select(
        "query_id",
        "db_operation",
        F.col("calls_state").alias("calls"),
        ms(F.col("duration_sum_state") / F.col("calls_state")).alias("avg_ms"),
        ms(F.element_at("q", 1)).alias("p95_ms"),
        ms(F.element_at("q", 2)).alias("p99_ms"),
    )
    return top(out, n, F.desc("p99_ms"), "query_id", "db_operation")


def top_by_p99_raw(events: DataFrame, now: datetime | None, span: Span = HOUR, n: int = 10, exact: bool = False) -> DataFrame:
    """R03's answer from raw events."""
    out = lookback(events, now, span, inclusive=True).groupBy("query_id", "db_operation").agg(
        F.count("*").alias("calls"), ms(F.avg("duration_us")).alias("avg_ms"), ms(quantile("duration_us", 0.95, exact)).alias("p95_ms"), ms(quantile("duration_us", 0.99, exact)).alias("p99_ms")
    )
    return top(out, n, F.desc("p99_ms"), "query_id", "db_operation")


def load_by_app(stored: DataFrame, now: datetime | None, span: Span = timedelta(minutes=30), rollup: Rollup | None = None, exact: bool = False) -> DataFrame:
    """R04, from the one-minute rollup."""
    rows = lookback(stored, now, span, "bucket", inclusive=True)
    merged = merged_quantiles(rows, rollup or app_user_stats(), ["app"], ("calls_state", "duration_sum_state", "errors_sum_state"), exact)
    return merged.select(
        "app",
        F.col("calls_state").alias("total_queries"),
        F.round(F.col("duration_sum_state") / 1000000, 2).alias("total_seconds"),
        ms(F.element_at("q", 2)).alias("p99_ms"),
        F.col("errors_sum_state").alias("errors"),
    ).orderBy(F.desc("total_seconds"), "app")


def error_rate_by_user(stored: DataFrame, now: datetime | None, span: Span = HOUR, rollup: Rollup | None = None) -> DataFrame:
    """R05, from the one-minute rollup; only pairs with errors."""
    rows = lookback(stored, now, span, "bucket", inclusive=True)
    merged = (rollup or app_user_stats()).merge(rows, ["db_name", "db_user"], ("calls_state", "errors_sum_state"))
    out = merged.select("db_name", "db_user", F.col("calls_state").alias("queries"), F.col("errors_sum_state").alias("errors"), percent(F.col("errors_sum_state"), F.col("calls_state")).alias("error_pct"))
    return out.where("errors > 0").orderBy(F.desc("error_pct"), "db_name", "db_user")


def latency_trend(events: DataFrame, query_id: int, now: datetime | None, span: Span = DAY, exact: bool = False) -> DataFrame:
    """R08."""
    rows = lookback(events.where(F.col("query_id") == signed_id(query_id)), now, span)
    return rows.groupBy(bucket("ts").alias("bucket")).agg(F.count("*").alias("calls"), ms(F.avg("duration_us")).alias("avg_ms"), ms(quantile("duration_us", 0.95, exact)).alias("p95_ms")).orderBy("bucket")


def signed_id(query_id: int | str) -> int:
    """A query id in either spelling, signed or unsigned, as the stored signed one."""
    value = int(query_id)
    if not -(2**63) <= value < 2**64:
        raise ValueError(f"no 64-bit query id: {query_id}")
    return value - 2**64 if value >= 2**63 else value


def slow_executions(events: DataFrame, now: datetime | None, span: Span = HOUR, over_us: int = 1_000_000, n: int = 20) -> DataFrame:
    """R09."""
    rows = lookback(events, now, span).where(F.col("duration_us") > over_us)
    out = rows.select("ts", (F.col("duration_us") / 1000).alias("ms"), "rows", "db_name", "db_user", "app", preview(200).alias("query_preview"), *keep_id(rows))
    return top(out, n, F.desc("ms"))


def qps(stored: DataFrame, now: datetime | None, span: Span = DAY, rollup: Rollup | None = None) -> DataFrame:
    """R16, from the five-minute rollup."""
    merged = (rollup or query_stats()).merge(lookback(stored, now, span, "bucket", inclusive=True), ["bucket"], ("calls_state",))
    return merged.select("bucket", (F.col("calls_state") / 300).alias("qps")).orderBy("bucket")


def workload_breakdown(events: DataFrame, now: datetime | None, span: Span = HOUR) -> DataFrame:
    """R18.  The total is a window over the few groups, not over rows."""
    out = lookback(events, now, span).groupBy("db_operation").agg(F.count("*").alias("queries"), ms(F.avg("duration_us")).alias("avg_ms"), F.sum("rows").alias("total_rows"))
    out = out.selectExpr("db_operation", "queries", "round(100 * queries / sum(queries) OVER (), 1) AS pct", "avg_ms", "total_rows")
    return out.orderBy(F.desc("queries"), "db_operation")


# -- cache, spills, writes ------------------------------------------------------------------------------


def cache_misses(events: DataFrame, now: datetime | None, span: Span = HOUR, over_blocks: int = 100, n: int = 20) -> DataFrame:
    """R10."""
    read, hit = F.col("shared_blks_read"), F.col("shared_blks_hit")
    rows = lookback(events, now, span).where(read > over_blocks)
    out = rows.select("ts", "query_id", "shared_blks_read", "shared_blks_hit", percent(read, hit + read).alias("miss_pct"), (F.col("duration_us") / 1000).alias("ms"), preview(100).alias("query_preview"), *keep_id(rows))
    return top(out, n, F.desc("shared_blks_read"))


def hit_ratio_trend(events: DataFrame, now: datetime | None, span: Span = DAY) -> DataFrame:
    """R11."""
    rows = lookback(events, now, span).where(F.col("shared_blks_hit") + F.col("shared_blks_read") > 0)
    out = rows.groupBy(bucket("ts").alias("bucket")).agg(F.count("*").alias("queries"), F.sum("shared_blks_hit").alias("hits"), F.sum("shared_blks_read").alias("reads"))
    return out.withColumn("hit_ratio", percent(F.col("hits"), F.col("hits") + F.col("reads") + 1)).orderBy("bucket")


def hit_ratio_rollup(stored: DataFrame, now: datetime | None, span: Span = DAY, rollup: Rollup | None = None) -> DataFrame:
    """R17, from the five-minute rollup."""
    merged = (rollup or query_stats()).merge(lookback(stored, now, span, "bucket", inclusive=True), ["bucket"], ("shared_hit_sum_state", "shared_read_sum_state"))
    hit, read = F.col("shared_hit_sum_state"), F.col("shared_read_sum_state")
    return merged.select("bucket", percent(hit, hit + read + 1).alias("hit_ratio_pct")).orderBy("bucket")


def spilling_queries(events: DataFrame, now: datetime | None, span: Span = HOUR, n: int = 10, exact: bool = False) -> DataFrame:
    """R12."""
    out = lookback(events, now, span).where("temp_blks_written > 0").groupBy("query_id").agg(
        F.count("*").alias("executions"), F.round(F.avg("temp_blks_written"), 0).alias("avg_temp_blks"), ms(F.avg("duration_us")).alias("avg_ms"), sample(preview(150), exact).alias("sample_query")
    )
    return top(out, n, F.desc("avg_temp_blks"), "query_id")


def wal_rate(events: DataFrame, now: datetime | None, span: Span = DAY) -> DataFrame:
    """R19."""
    rows = lookback(events, now, span).where(F.col("db_operation").isin("INSERT", "UPDATE", "DELETE"))
    out = rows.groupBy(bucket("ts", "1 minute").alias("bucket")).agg(F.sum("wal_bytes").alias("wal_bytes"), F.sum("wal_fpi").alias("full_page_images"))
    return out.select("bucket", "wal_bytes", F.round(F.col("wal_bytes") / 1048576, 2).alias("wal_mb"), "full_page_images").orderBy("bucket")


def dirty_blocks(events: DataFrame, now: datetime | None, span: Span = DAY) -> DataFrame:
    """R20."""
    sums = {"shared_dirtied": "shared_blks_dirtied", "local_dirtied": "local_blks_dirtied", "temp_written": "temp_blks_written"}
    return lookback(events, now, span).groupBy(bucket("ts", "1 minute").alias("bucket")).agg(*[F.sum(c).alias(n) for n, c in sums.items()]).orderBy("bucket")


# -- parallel workers, JIT, I/O time --------------------------------------------------------------------


def unlaunched_workers(events: DataFrame, now: datetime | None, span: Span = DAY, n: int = 10) -> DataFrame:
    """R21."""
    planned, launched = F.col("parallel_workers_planned"), F.col("parallel_workers_launched")
    out = lookback(events, now, span).where(planned > launched).groupBy("query_id", "db_operation").agg(
        F.count("*").alias("executions"), F.round(F.avg(planned), 1).alias("avg_planned"), F.round(F.avg(launched), 1).alias("avg_launched"), F.round(F.avg(planned - launched), 1).alias("avg_missed")
    )
    return top(out, n, F.desc("avg_missed"), "query_id", "db_operation")


def jit_overhead(events: DataFrame, now: datetime | None, span: Span = DAY, over_ms: float = 10, n: int = 10) -> DataFrame:
    """R22.  Deforming is part of generation and not added again."""
    phases = [F.col(f"jit_{p}_time_us").cast("long") for p in ("generation", "inlining", "optimization", "emission")]
    rows = lookback(events, now, span).where("jit_functions > 0").withColumn("jit_us", sum(phases[1:], phases[0]))
    out = rows.groupBy("query_id").agg(F.count("*").alias("executions"), F.avg("duration_us").alias("total"), F.avg("jit_us").alias("jit"))
    out = out.select("query_id", "executions", ms(F.col("total")).alias("avg_total_ms"), ms(F.col("jit")).alias("avg_jit_ms"), percent(F.col("jit"), F.greatest("total", F.lit(1.0)), 1).alias("jit_pct_of_total"))
    return top(out.where(F.col("avg_jit_ms") > over_ms), n, F.desc("jit_pct_of_total"), "query_id")


def worker_shortfall(events: DataFrame) -> DataFrame:
    """R23."""
    planned, launched = F.col("parallel_workers_planned"), F.col("parallel_workers_launched")
    out = events.where(planned > launched).select("query_id", "db_operation", planned.alias("planned"), launched.alias("launched"), (planned - launched).alias("workers_missed"), *keep_id(events))
    return top(out, None, F.desc("workers_missed"))


def io_time(events: DataFrame) -> DataFrame:
    """R24."""
    rows = events.where("local_blk_read_time_us > 0 OR local_blk_write_time_us > 0")
    return rows.selectExpr("query_id", "local_blk_read_time_us + local_blk_write_time_us AS local_io_us", "shared_blk_read_time_us + shared_blk_write_time_us AS shared_io_us")


def jit_deform_outliers(events: DataFrame, over_us: int = 1000) -> DataFrame:
    """R25."""
    other = "CAST(jit_generation_time_us AS BIGINT) + jit_inlining_time_us + jit_optimization_time_us + jit_emission_time_us AS other_jit_us"
    return events.where(F.col("jit_deform_time_us") > over_us).selectExpr("query_id", "jit_functions", "jit_deform_time_us", other)


# -- issues and errors ----------------------------------------------------------------------------------


def recent_issues(errors: DataFrame, now: datetime | None, span: Span = HOUR, n: int = 100) -> DataFrame:
    """R06, from the error view."""
    rows = lookback(errors, now, span)
    return top(rows.select("ts", "db_name", "db_user", "app", "err_sqlstate", "err_message", preview(200).alias("query_preview"), *keep_id(rows)), n, F.desc("ts"))


def issues_by_state(errors: DataFrame, now: datetime | None, span: Span = DAY, exact: bool = False) -> DataFrame:
    """R07, from the error view."""
    return by_state(lookback(errors, now, span), "occurrences", exact)


def errors_by_state(events: DataFrame, now: datetime | None, span: Span = DAY, exact: bool = False) -> DataFrame:
    """Errors proper, without warnings."""
    return by_state(lookback(events, now, span).where(F.col("err_elevel") >= ERROR), "errors", exact)


def by_state(rows: DataFrame, count: str, exact: bool) -> DataFrame:
    out = rows.groupBy("err_sqlstate").agg(F.count("*").alias(count), distinct("query_id", exact).alias("unique_queries"), sample("err_message", exact).alias("sample_message"))
    return out.orderBy(F.desc(count), "err_sqlstate")


def error_rate(events: DataFrame, now: datetime | None, span: Span = DAY) -> DataFrame:
    """R14."""
    out = lookback(events, now, span).groupBy(bucket("ts").alias("bucket")).agg(F.count("*").alias("total_queries"), F.count_if(F.col("err_elevel") >= ERROR).alias("errors"))
    return out.withColumn("error_pct", percent(F.col("errors"), F.col("total_queries"))).orderBy("bucket")


def errors_of_query(errors: DataFrame, query_id: int, n: int = 20) -> DataFrame:
    """R15, from the error view.  Captured errors carry query id 0, so other ids find nothing."""
    rows = errors.where(F.col("query_id") == signed_id(query_id))
    return top(rows.select("ts", "err_sqlstate", "err_elevel", "err_message", preview(200).alias("query_preview"), *keep_id(rows)), n, F.desc("ts"))


def latest_issues(errors: DataFrame, n: int = 10) -> DataFrame:
    """R27."""
    return top(errors.select("ts", "err_sqlstate", "err_message", preview(80).alias("query_preview"), *keep_id(errors)), n, F.desc("ts"))


# -- short looks ----------------------------------------------------------------------------------------


def latest_events(events: DataFrame, n: int = 10, identified: bool = False) -> DataFrame:
    """R26; with `identified` R29: only events that carry a query id."""
    rows = events.where("query_id <> 0") if identified else events
    return top(rows.select("ts", "db_name", "db_operation", (F.col("duration_us") / 1000).alias("ms"), "rows", preview(80).alias("query_preview"), *keep_id(rows)), n, F.desc("ts"))


def marker_count(events: DataFrame, marker: str, now: datetime | None, span: Span = timedelta(minutes=10)) -> DataFrame:
    """R28."""
    rows = lookback(events, now, span).where((F.instr("query_text", marker) > 0) & (F.col("query_id") != 0))
    return rows.agg(F.count("*").alias("n"))


def total(events: DataFrame) -> DataFrame:
    """R30."""
    return events.agg(F.count("*").alias("n"))


def count_by_operation(events: DataFrame) -> DataFrame:
    """R31."""
    return events.groupBy("db_operation").agg(F.count("*").alias("n")).orderBy("db_operation")


def duration_stats(events: DataFrame, *patterns: str) -> DataFrame:
    """Over events whose text is like any of the patterns."""
    like = F.lit(not patterns)
    for p in patterns:
        like = like | F.col("query_text").like(p)
    d = "duration_us"
    return events.where(like).agg(F.count("*").alias("n"), F.avg(d).alias("avg_us"), F.min(d).alias("min_us"), F.max(d).alias("max_us"))


def max_duration(events: DataFrame) -> DataFrame:
    """R33."""
    return events.agg(F.max("duration_us").alias("max_us"))


def latest_duration(events: DataFrame, pattern: str) -> DataFrame:
    """R34."""
    rows = events.where(F.col("query_text").like(pattern))
    return top(rows.select("ts", "duration_us", *keep_id(rows)), 1, F.desc("ts")).select("duration_us")


def texts_of_backend(events: DataFrame, pid: int, unlike: str) -> DataFrame:
    """The texts, sorted, as one array; made of the distinct texts and their counts, so repeated ones do not gather."""
    found = F.sort_array(F.collect_list(F.struct("query_text", "n")))
    return text_counts(events, pid, unlike).agg(F.flatten(F.transform(found, lambda x: F.array_repeat(x["query_text"], x["n"].cast("int")))).alias("texts"))


def text_counts(events: DataFrame, pid: int, unlike: str) -> DataFrame:
    """R35 as rows: each text of a backend and how often it ran; the form for backends with very many texts."""
    rows = events.where((F.col("pid") == pid) & ~F.col("query_text").like(unlike) & (F.col("query_text") != ""))
    return rows.groupBy("query_text").agg(F.count("*").alias("n"))


def envelope(events: DataFrame, n: int = 1) -> DataFrame:
    """R36."""
    names = ["instance_ubid", "server_role", "region", "cell", "read_replica_type"]
    return events.where("instance_ubid <> ''").select(*names).distinct().orderBy(*names).limit(n)


def text_loss(events: DataFrame) -> DataFrame:
    """R37."""
    empty = F.col("query_text") == ""
    measured = empty & (F.col("duration_us") > 0) & (F.col("db_name") != "") & (F.col("db_operation") != "")
    return events.agg(F.count_if(empty).alias("without_text"), F.count_if(measured).alias("without_text_measured"), F.count_if(~empty).alias("with_text"))


# -- the ingest's own counters --------------------------------------------------------------------------


def health(stats: DataFrame, version: str) -> DataFrame:
    """R38."""
    status = (
        F.when(F.col("send_failures") > 0, "EXPORT ERRORS")
        .when(F.col("dropped_events") > 0, "DROPS DETECTED")
        .when(F.col("queue_usage_pct") > 80, "QUEUE PRESSURE")
        .when(F.col("enqueued_events") == 0, "NO EVENTS")
        .otherwise("OK")
    )
    return stats.select(F.lit(version).alias("version"), "enqueued_events", "exported_events", "dropped_events", "send_failures", F.round("queue_usage_pct", 1).alias("queue_pct"), "last_error_text", status.alias("status"))


def in_flight(stats: DataFrame) -> DataFrame:
    """R39, first view."""
    return stats.select("enqueued_events", "exported_events", (F.col("enqueued_events") - F.col("exported_events")).alias("in_flight"), "dropped_events")


def export_errors(stats: DataFrame) -> DataFrame:
    """R39, second view."""
    return stats.select("send_failures", "last_error_text", "last_error_ts", "last_success_ts")


def queue_pressure(stats: DataFrame) -> DataFrame:
    """R39, third view."""
    return stats.select("queue_size", "queue_capacity", F.round("queue_usage_pct", 1).alias("usage_pct"))


def events_captured(stats: DataFrame, at_least: int) -> DataFrame:
    """R39, the check that events arrive: whether any counters are above zero, and whether they have reached a number."""
    one = stats.sparkSession.range(1)
    any_row = stats.where("enqueued_events > 0").agg(F.count("*")).scalar()
    return one.select((any_row > 0).alias("events_captured"), (stats.select("enqueued_events").scalar() >= at_least).alias("more_events"))
