"""The table of named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def rnd(c, digits: int = 6) -> Column:
    """Half-up rounding by the same arithmetic on every engine."""
    c = F.col(c) if isinstance(c, str) else c
    scale = float(10 ** digits)
    return F.floor(c * scale + 0.5) / scale


def sql_rnd(expr: str, digits: int = 6) -> str:
    return f"floor(({expr}) * 1e{digits} + 0.5) / 1e{digits}"


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_case(column: str, table: dict, default: str) -> str:
    """A fixed lookup as CASE."""
    whens = " ".join(f"WHEN {sql_str(k)} THEN {sql_str(v)}" for k, v in table.items())
    return f"CASE {column} {whens} ELSE {default} END"
