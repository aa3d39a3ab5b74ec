"""Time buckets and lookbacks."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket(ts: str | Column, width: str = "5 minutes") -> Column:
    """Start of the tumbling window that holds ts, of ts's own type."""
    return F.window(ts, width)["start"]


def lookback(df: DataFrame, now: datetime | None, span: timedelta | None, column: str = "ts", inclusive: bool = False) -> DataFrame:
    """Rows within `span` before `now`; all rows if either is None.

    A table partitioned by event_date also gets the filter on it that the one on `column` implies, so that
    partitions are pruned; Spark can't infer it from a date computed at write time.
    """
    if now is None or span is None:
        return df
    since = now - span
    bound = F.lit(since).cast(df.schema[column].dataType)
    out = df.where(F.col(column) >= bound if inclusive else F.col(column) > bound)
    day = "event_date" if column == "ts" else f"{column}_date"
    return out.where(F.col(day) >= F.lit(since.date())) if day in df.columns else out


def second(ts: str | Column) -> Column:
    """ts without its fraction of a second."""
    return F.window(ts, "1 second")["start"]
