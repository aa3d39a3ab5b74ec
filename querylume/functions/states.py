"""Mergeable partial aggregates: what a rollup stores, and how it is merged and finished at read."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class State:
    """`write()` aggregates rows into the stored column `name`; `merge(name)` aggregates stored columns.

    Both are called with a session at hand; states themselves can be declared without one.
    """

    name: str
    write: Callable[[], Column]
    merge: Callable[[str], Column]
    sketch: bool = False


def count_state(name: str = "calls_state") -> State:
    return State(name, lambda: F.count(F.lit(1)), F.sum)


def sum_state(name: str, x: str) -> State:
    """x, here and below: a SQL expression over the event's columns."""
    return State(name, lambda: F.sum(F.expr(x)), F.sum)


def min_state(name: str, x: str) -> State:
    return State(name, lambda: F.min(F.expr(x)), F.min)


def max_state(name: str, x: str) -> State:
    return State(name, lambda: F.max(F.expr(x)), F.max)


def quantile_state(name: str, x: str, k: int = 4096) -> State:
    """A KLL sketch of a whole-number expression; rank errors shrink as k grows (about 0.06 % at 4096)."""
    return State(name, lambda: F.kll_sketch_agg_bigint(F.expr(x), F.lit(k)), lambda c: F.kll_merge_agg_bigint(c, F.lit(k)), sketch=True)


def quantiles(sketch: str | Column, *q: float) -> Column:
    """Array of quantiles, read from the sketch once."""
    return F.kll_sketch_get_quantile_bigint(sketch, F.array(*[F.lit(float(x)) for x in q]))


def exact_quantiles(counted: DataFrame, by: Sequence[str], x: str, n: str, *q: float) -> DataFrame:
    """`by` and an array q of discrete quantiles of x, which occurs n times in each row of `counted`.

    The quantile is the least x that a share q of the group does not exceed; shares are compared as decimals.
    Equal values are added up first, so a group is as many rows as it has distinct values.
    """
    values = counted.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.sum(n).alias("n"))
    group = Window.partitionBy(*by)
    upto = F.sum("n").over(group.orderBy(x).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = values.select(*by, x, upto.alias("upto"), F.sum("n").over(group).alias("total"))
    least = [F.min(F.when(F.col("upto") >= F.col("total") * F.lit(Decimal(str(share))), F.col(x))) for share in q]
    return ranked.groupBy(*by).agg(F.array(*least).alias("q"))
