"""Rollups of partial states, the two filtered views, and users' own rollups."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame

from querylume.functions.buckets import bucket, lookback
from querylume.functions.states import State, count_state, max_state, min_state, quantile_state, sum_state
from querylume.sources.schema import ERROR_COLUMNS


@dataclass(frozen=True)
class Rollup:
    """Keys, bucket width and states.  build() is what an ingest batch appends; merge() is what a query reads.

    Late rows just add a state row to their old bucket, so nothing is ever dropped.  States of one key may
    lie in any number of rows; merging merged states again changes nothing.
    """

    name: str
    keys: tuple[str, ...]
    width: str
    states: tuple[State, ...]

    def build(self, events: DataFrame) -> DataFrame:
        rows = events.withColumn("bucket", bucket("ts", self.width))
        return rows.groupBy("bucket", *self.keys).agg(*[s.write().alias(s.name) for s in self.states])

    def merge(self, stored: DataFrame, by: tuple[str, ...] | list[str] = (), states: tuple[str, ...] | None = None, *extra: Column) -> DataFrame:
        """Stored states merged by `by`; only the named states are read."""
        chosen = [s for s in self.states if states is None or s.name in states]
        return stored.groupBy(*by).agg(*[s.merge(s.name).alias(s.name) for s in chosen], *extra)

    def compact(self, stored: DataFrame) -> DataFrame:
        """One row for each bucket and key; the states' meaning is unchanged."""
        return self.merge(stored, ("bucket", *self.keys)).select("bucket", *self.keys, *[s.name for s in self.states])

    def by_value(self, x: str) -> Rollup:
        """This rollup with a column x among its keys instead of sketches: x's values with their counts, so quantiles of it are exact.

        It has at most as many rows as events, and no row grows with a group.
        """
        return replace(self, name=f"{self.name}_by_{x}", keys=(*self.keys, x), states=tuple(s for s in self.states if not s.sketch))


def query_stats(k: int = 4096) -> Rollup:
    states = (
        count_state(),
        sum_state("duration_sum_state", "duration_us"),
        min_state("duration_min_state", "duration_us"),
        max_state("duration_max_state", "duration_us"),
        quantile_state("duration_q_state", "duration_us", k),
        sum_state("rows_sum_state", "rows"),
        sum_state("shared_hit_sum_state", "shared_blks_hit"),
        sum_state("shared_read_sum_state", "shared_blks_read"),
    )
    return Rollup("query_stats_5m", ("instance_ubid", "db_name", "query_id", "db_operation"), "5 minutes", states)


def app_user_stats(k: int = 4096) -> Rollup:
    states = (
        count_state(),
        sum_state("duration_sum_state", "duration_us"),
        quantile_state("duration_q_state", "duration_us", k),
        sum_state("errors_sum_state", "CAST(err_elevel > 0 AS BIGINT)"),
    )
    return Rollup("db_app_user_1m", ("instance_ubid", "db_name", "app", "db_user", "db_operation"), "1 minute", states)


REGISTERED: dict[str, Rollup] = {r.name: r for r in (query_stats(), app_user_stats())}


def register_rollup(name: str, keys: tuple[str, ...], states: tuple[State, ...], width: str = "5 minutes") -> Rollup:
    """A rollup of one's own; streaming ingest maintains whatever is registered."""
    if name in REGISTERED:
        raise ValueError(f"rollup {name} is already registered")
    REGISTERED[name] = Rollup(name, tuple(keys), width, tuple(states))
    return REGISTERED[name]


def events_recent(events: DataFrame, now: datetime | None, span: timedelta | None = timedelta(hours=1)) -> DataFrame:
    """Every column of the last hour's events."""
    return lookback(events, now, span)


def errors_recent(events: DataFrame, now: datetime | None = None, span: timedelta | None = timedelta(days=7)) -> DataFrame:
    """Events with an issue, in twelve columns, of the last seven days."""
    extra = [c for c in ("event_id", "event_date") if c in events.columns]
    return lookback(events.where("err_elevel > 0"), now, span).select(*ERROR_COLUMNS, *extra)
