"""Min-max and z-score scaling over all rows or per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fewlabel.operators.joins import join_small

EPSILON = 1e-10  # guards the divisions of the epsilon forms


def _finite(x: Column) -> Column:
    return F.when((F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x), x)


def guarded(x: Column, low: Column, high: Column) -> Column:
    """(x - low) / (high - low); 0 for a constant column; infinities clamp to the ends."""
    inf = float("inf")
    return (F.when(x == F.lit(inf), F.lit(1.0))
            .when(x == F.lit(-inf), F.lit(0.0))
            .when(high > low, (x - low) / (high - low))
            .otherwise(F.when(x.isNotNull(), F.lit(0.0))))


def min_max(df: DataFrame, columns: dict[str, str], within: Sequence[str] | None = None) -> DataFrame:
    """Add ``columns[new] = scaled old``, over all rows or inside each (bounded) ``within`` group.

    The global bounds are one aggregate row read as a scalar subquery, never an
    un-partitioned window.
    """
    if within:
        w = Window.partitionBy(*within)
        for new, old in columns.items():
            x = F.col(old).cast("double")
            df = df.withColumn(new, guarded(x, F.min(_finite(x)).over(w), F.max(_finite(x)).over(w)))
        return df
    bounds = df.agg(F.struct(*[
        f(_finite(F.col(old).cast("double"))).alias(f"{tag}_{i}")
        for i, old in enumerate(columns.values())
        for tag, f in (("low", F.min), ("high", F.max))]).alias("bounds"))
    df = df.withColumn("_bounds", bounds.scalar())
    for i, (new, old) in enumerate(columns.items()):
        df = df.withColumn(new, guarded(F.col(old).cast("double"),
                                        F.col(f"_bounds.low_{i}"), F.col(f"_bounds.high_{i}")))
    return df.drop("_bounds")


def normalise_per_group(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Epsilon min-max (``*_mm``) and z-score (``*_z``, population deviation) per group.

    One aggregate per group joined back: a language with a third of the rows stays spread
    over its input partitions.
    """
    stats = df.groupBy(group).agg(*[
        f(_finite(F.col(c).cast("double"))).alias(f"_{tag}_{c}")
        for c in columns
        for tag, f in (("low", F.min), ("high", F.max), ("mean", F.avg), ("dev", F.stddev_pop))])
    out = join_small(df, stats, [group])
    for c in columns:
        x = F.col(c).cast("double")
        span = F.col(f"_high_{c}") - F.col(f"_low_{c}") + F.lit(EPSILON)
        out = (out.withColumn(f"{c}_mm", (x - F.col(f"_low_{c}")) / span)
               .withColumn(f"{c}_z", (x - F.col(f"_mean_{c}")) / (F.col(f"_dev_{c}") + F.lit(EPSILON))))
    return out.drop(*[f"_{tag}_{c}" for c in columns for tag in ("low", "high", "mean", "dev")])
