"""Which retrieved rows join the target rows in which epoch."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fewlabel.functions.ordering import rank_in_group
from fewlabel.operators.combine import retrieved_only, target_only

SCHEDULES = ("linear", "exponential", "stepwise", "strict", "strict_separate")


def ratio(schedule: str, epoch: int, epochs: int) -> float:
    """Share of retrieved rows in a 0-based epoch; epoch 0 has none. Fixed formulas."""
    if schedule not in SCHEDULES:
        raise ValueError(f"unknown schedule: {schedule}")
    last = epochs - 1
    if epoch == 0:
        return 0.0
    if schedule == "linear":
        return epoch / last
    if schedule == "exponential":
        return 1 - math.exp(-epoch / (last / 3))
    if schedule == "stepwise":
        steps = [(0.3, 0.0), (0.5, 0.3), (0.7, 0.6)]
        return next((share for upto, share in steps if epoch < last * upto), 1.0)
    if schedule == "strict":
        return 0.0 if epoch <= (5 if last > 6 else 3) else 1.0
    return 0.0 if epoch < 10 else 1.0


def ranked_retrieved(df: DataFrame, key: str, ascending: bool = True) -> DataFrame:
    """Retrieved rows with their 1-based place by score."""
    order = F.col("score").asc() if ascending else F.col("score").desc()
    return rank_in_group(retrieved_only(df), [], [order, F.col(key)], "place")


def slices(df: DataFrame, epochs: int, schedule: str = "linear", key: str = "id",
           ascending: bool = True) -> DataFrame:
    """The training rows of every epoch in one table, with an ``epoch`` column."""
    shares = [ratio(schedule, e, epochs) for e in range(epochs)]
    ranked = ranked_retrieved(df, key, ascending)
    total = retrieved_only(df).agg(F.count(F.lit(1)).alias("n"))
    plan = F.array(*[F.struct(F.lit(e).alias("epoch"), F.lit(float(s)).alias("share"))
                     for e, s in enumerate(shares)])
    late = (ranked.withColumn("_n", total.scalar()).withColumn("_e", F.explode(plan))
            .where(F.col("place") <= F.floor(F.col("_n") * F.col("_e.share")))
            .withColumn("epoch", F.col("_e.epoch")).drop("_n", "_e", "place"))
    with_target = [e for e, s in enumerate(shares) if not (schedule == "strict_separate" and s == 1.0)]
    base = target_only(df).withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in with_target])))
    return base.unionByName(late)


def average_size(schedule: str, m: Column, n: Column, epochs: int) -> Column:
    """Mean training rows per epoch for m target and n retrieved rows. Fixed formulas."""
    if schedule in ("linear", "strict"):
        return m + 0.5 * n
    if schedule == "exponential":
        return m + 0.75 * n
    if schedule == "stepwise":
        return m + 0.48 * n
    if schedule == "strict_separate":
        return m.cast("double") if epochs < 10 else (m * 10 + n * (epochs - 10)) / epochs
    raise ValueError(f"unknown schedule: {schedule}")


def plan_steps(df: DataFrame, epochs: int, batch_size: int, accumulation: int) -> DataFrame:
    """Optimizer steps of every schedule."""
    counts = df.agg(F.count(F.when(F.col("source") == 0, 1)).alias("m"),
                    F.count(F.when(F.col("source") == 1, 1)).alias("n"))
    m, n = F.col("m"), F.col("n")
    rows = F.array(*[
        F.struct(F.lit(s).alias("schedule"), average_size(s, m, n, epochs).cast("double").alias("avg_size"))
        for s in SCHEDULES])
    return (counts.select("m", "n", F.inline(rows))
            .withColumn("max_steps", F.ceil(F.col("avg_size") * epochs / (batch_size * accumulation))))
