"""Run tables to report matrices, votes and mean signals."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fewlabel.session import durable


def pick_metric(*columns: str):
    """First metric column that is present."""
    return F.coalesce(*[F.col(c) for c in columns])


def seed_average(runs: DataFrame, keys: Sequence[str], metric: str, min_runs: int = 3,
                 digits: int | None = 2, name: str = "score") -> DataFrame:
    """Mean over seeds times 100, half-even rounded; null below ``min_runs`` runs."""
    mean = F.avg(metric) * 100
    value = F.bround(mean, digits) if digits is not None else mean
    n = F.count(metric)
    return runs.groupBy(*keys).agg(n.alias("n_runs"), F.when(n >= min_runs, value).alias(name))


def full_grid(averages: DataFrame, dims: dict[str, Sequence]) -> DataFrame:
    """Every combination of the listed dimension values, with nulls where no run exists.
    The grid is built from the literal value lists."""
    spark = averages.sparkSession
    grid = reduce(lambda g, kv: g.withColumn(kv[0], F.explode(F.array(*[F.lit(v) for v in kv[1]]))),
                  dims.items(), spark.range(1).drop("id"))
    return grid.join(averages, list(dims), "left")


def matrix(averages: DataFrame, rows: Sequence[str], column: str, values: Sequence, value: str = "score",
           prefix: str = "") -> DataFrame:
    """Pivot with the listed column values, so no extra pass looks them up."""
    out = averages.groupBy(*rows).pivot(column, list(values)).agg(F.max(value))
    return out.select(*rows, *[F.col(f"`{v}`").alias(f"{prefix}{v}") for v in values])


def best_model_vote(scores: DataFrame, groups: Sequence[str], model: str, position: str, score: str,
                    listed: Sequence[str] = ()) -> DataFrame:
    """Per group the model that reaches the top score at most positions; ties go to the first of ``listed``, then by name."""
    top = scores.groupBy(*groups, position).agg(F.max(score).alias("_top"))
    wins = (scores.join(top, [*groups, position])
            .groupBy(*groups, model).agg(F.sum((F.col(score) >= F.col("_top")).cast("long")).alias("wins")))
    place = F.array_position(F.array(*[F.lit(m) for m in listed]), F.col(model)) if listed else F.lit(0)
    w = Window.partitionBy(*groups).orderBy(F.desc("wins"), F.when(place > 0, place).otherwise(len(listed) + 1), model)
    return wins.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def mean_by(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])


def descriptive_stats(df: DataFrame, by: Sequence[str], label: str = "label") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_total"), F.sum(label).alias("n_positive"),
                               F.avg(label).alias("positive_share"))


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def _text_key(text: str):
    """A digest that tells texts apart; null texts are one text, other than the empty one."""
    return F.coalesce(F.sha2(text, 256), F.lit("null"))


def duplicate_audit(df: DataFrame, text: str, order: Sequence[str]) -> DataFrame:
    """Rows whose text occurred earlier in ``order``.

    The first position of every text is an aggregate; texts that occur once leave there, and
    the others are looked up so that one very frequent text does not load one task.
    """
    from fewlabel.operators.joins import lookup
    keyed = df.withColumn("_text", _text_key(text))
    firsts = durable(keyed.groupBy("_text")
                     .agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*order)).alias("_first"))
                     .where("_n > 1"), "firsts")
    seen = lookup(keyed, firsts, ["_text"], "_n")
    return seen.where(F.struct(*order) != F.col("_first")).drop("_text", "_n", "_first")


def duplicate_totals(df: DataFrame, text: str) -> DataFrame:
    """Number of texts and of distinct texts."""
    per_text = df.groupBy(_text_key(text).alias("_text")).agg(F.count(F.lit(1)).alias("_n"))
    return per_text.agg(F.sum("_n").alias("n_texts"), F.count(F.lit(1)).alias("n_distinct"))
