"""Choice between raw events and a stored rollup."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylume.functions.buckets import lookback
from querylume.operators.rollups import Rollup

WIDTHS = {"1 minute": timedelta(minutes=1), "5 minutes": timedelta(minutes=5)}


def answers(rollup: Rollup, keys: Iterable[str], states: Iterable[str], now: datetime | None, span: timedelta | None) -> bool:
    """Whether a rollup gives what raw events would: it has the keys and states, and whole buckets cover the range."""
    if not set(keys) <= {"bucket", *rollup.keys} or not set(states) <= {s.name for s in rollup.states}:
        return False
    width = WIDTHS.get(rollup.width)
    if now is None or span is None:
        return True
    return width is not None and span >= width and not (now - span - datetime(1970, 1, 1)) % width


def routed_workload(events: DataFrame, stored: DataFrame, now: datetime | None, span: timedelta | None, rollup: Rollup) -> DataFrame:
    """Calls and time by operation, from the rollup if it can answer, else from events."""
    states = ("calls_state", "duration_sum_state")
    if answers(rollup, ["db_operation"], states, now, span):
        merged = rollup.merge(lookback(stored, now, span, "bucket", inclusive=True), ["db_operation"], states)
        return merged.select("db_operation", F.col("calls_state").alias("calls"), F.col("duration_sum_state").alias("duration_us"))
    rows = lookback(events, now, span, inclusive=True)
    return rows.groupBy("db_operation").agg(F.count("*").alias("calls"), F.sum("duration_us").alias("duration_us"))
