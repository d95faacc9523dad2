"""Vector expressions in double precision, summed left to right."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v) -> Column:
    return _col(v).cast("array<double>")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    return total(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm(a) -> Column:
    return F.sqrt(total(F.transform(as_double(a), lambda x: x * x)))


def cosine(a, b) -> Column:
    """A zero vector is similar to nothing (0)."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length).when(length.isNotNull(), 0.0)


def unit(a) -> Column:
    """The vector scaled to length one; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(as_double(a), lambda x: F.when(n > 0, x / n).otherwise(x))


def arg_max(a) -> Column:
    """0-based position of the first largest entry."""
    return (F.array_position(_col(a), F.array_max(_col(a))) - 1).cast("int")
