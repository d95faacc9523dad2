"""Column helpers shared by the text operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bounded_batches(spark, size: str = "4m") -> None:
    """From now on Arrow batches of the session carry about ``size`` bytes, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def text_of(column: str) -> Column:
    """A null text counts as the empty one."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def held_out(column: str, parts: int) -> Column:
    """True where crc32 of the id, written as text, is divisible by ``parts``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % parts == 0, F.lit(False))


def locate(text: Column, hits: Column, pattern: str) -> Column:
    """``array<struct<start, end, value>>`` for ``hits``, all leftmost matches of ``pattern`` in ``text``.

    The pieces between the matches come from ``split``, so running lengths give the offsets in code points
    (end exclusive) without leaving the JVM. The text is split only where there is a hit.
    """
    nothing = F.array().cast("array<struct<start:int,end:int,value:string>>")
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"))

    def step(acc, piece):
        start = acc["pos"] + F.length(piece["gap"])
        end = start + F.length(piece["hit"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), piece["hit"].alias("value")))
        return F.when(piece["hit"].isNull(), acc).otherwise(
            F.struct(end.alias("pos"), F.concat(acc["out"], one).alias("out")))

    walked = F.aggregate(pieces, F.struct(F.lit(0).alias("pos"), nothing.alias("out")), step, lambda acc: acc["out"])
    return F.when(F.size(hits) > 0, walked).otherwise(nothing)


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.concat_ws(",", F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def largest(df: DataFrame, column: str, most: int) -> DataFrame:
    """The rows of ``df`` with the largest values of a positive ``column``, ``most`` at most.

    The bound comes from a histogram of the values' magnitudes (sixteen steps per doubling), so neither the driver nor a
    task ever holds more than the rows returned; a step that would exceed ``most`` stays out as a whole. ``df`` is read twice.
    """
    level = F.floor(F.log2(column) * 16)
    total, bound = 0, None
    for r in sorted(df.groupBy(level.alias("level")).count().where("level IS NOT NULL").collect(), reverse=True):
        total += r["count"]
        if total > most:
            break
        bound = r["level"]
    return df.where(F.lit(False) if bound is None else level >= bound)


def frame(columns: dict) -> pd.DataFrame:
    """A result batch. Strings and lists stay Python objects, which become one Arrow array each."""
    out = {}
    for name, values in columns.items():
        if isinstance(values, pd.Series):
            values = values.reset_index(drop=True)
            values = values.astype(object) if isinstance(values.dtype, pd.StringDtype) else values
        elif isinstance(values, list):
            values = pd.Series(values, dtype=object)
        out[name] = values
    return pd.DataFrame(out)
