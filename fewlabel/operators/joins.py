"""Joins whose physical form depends on a checked size or on hot keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fewlabel.session import durable

MAX_BROADCAST_ROWS = 500_000
MAX_BROADCAST_KEYS = 2_000_000  # numbers alone, about 100 MB
HOT_KEYS = 1000


def join_small(left: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner",
               max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Join an aggregated side that is written once and broadcast only when its counted
    rows stay below ``max_rows``; otherwise the planner picks a shuffled join. Null keys match
    each other, so rows without a group are kept."""
    side = durable(small, "side")
    if side.count() <= max_rows:
        side = F.broadcast(side)
    for c in on:
        side = side.withColumnRenamed(c, f"_key_{c}")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in on])
    return left.join(side, same, how).drop(*[f"_key_{c}" for c in on])


def only_keys(wide: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows of ``wide`` whose ``on`` is among ``keys``, ahead of joins that would shuffle all of them. The keys are written
    and counted; more than ``MAX_BROADCAST_KEYS`` leave the choice of the join to the planner."""
    listed = durable(keys.select(on).where(F.col(on).isNotNull()).distinct(), "keys")
    if listed.count() <= MAX_BROADCAST_KEYS:
        listed = F.broadcast(listed)
    return wide.join(listed, on, "left_semi")


def lookup_counted(left: DataFrame, right: DataFrame, on: Sequence[str], weight: str, rows: int) -> DataFrame:
    """``lookup``, or one broadcast when the counted ``rows`` of the unique side allow it."""
    if rows <= MAX_BROADCAST_ROWS:
        return left.join(F.broadcast(right), list(on))
    return lookup(left, right, on, weight)


def lookup(left: DataFrame, right: DataFrame, on: Sequence[str], weight: str) -> DataFrame:
    """Inner join onto a side with unique keys that knows, in ``weight``, how often each key occurs.
    The side is read three times: pass it cheap or written.

    Keys above a thousandth of all occurrences number at most a thousand, so they are
    broadcast; the remaining keys are too light to skew the shuffled join.
    """
    on = list(on)
    total = right.agg(F.sum(weight).alias("t")).scalar()
    hot = right.where(F.col(weight) * HOT_KEYS > total)
    cold_rows = left.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return (left.join(F.broadcast(hot), on)
            .unionByName(cold_rows.join(right, on)))
