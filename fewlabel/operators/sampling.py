"""Deterministic sampling and splitting in hash order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fewlabel.functions.ordering import hash_key, hash_rank
from fewlabel.operators.joins import join_small

# Learning-curve sizes, number of seeds, and the largest size for other languages.
CURVE_SIZES = [10, 20, 30, 40, 50, 100, 200, 300, 400, 500, 1000, 2000, 3000, 4000, 5000, 10000, 20000]
CURVE_SEEDS = 10
OTHER_LANGUAGE_MAX = 2000
TEST_SIZE, DEV_SIZE = 2000, 500
# Datasets with their own (test, dev) sizes.
SPLIT_SIZES = {"ous19_fr": (1500, 500), "ous19_ar": (1000, 300)}


def sample_n(df: DataFrame, n: int, id_col: str, seed: int = 123, groups: Sequence[str] = ()) -> DataFrame:
    """Exactly n rows without replacement, per group if asked."""
    groups = list(groups)
    rows = df if groups else df.withColumn("_all", F.lit(0))
    out = hash_rank(rows, groups or ["_all"], hash_key(id_col, seed=str(seed)), n, "_place").drop("_place")
    return out if groups else out.drop("_all")


def split_train_dev_test(df: DataFrame, id_col: str, dataset: str, test: int = TEST_SIZE, dev: int = DEV_SIZE,
                         overrides: dict[str, tuple[int, int]] | None = None, seed: int = 123) -> DataFrame:
    """Add ``split``: per dataset the first ``test`` rows in hash order, then ``dev``, the rest train."""
    sizes = overrides or {}

    def size(i, default):
        if not sizes:
            return F.lit(default)
        table = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, v[i])])
        return F.coalesce(table[F.col(dataset)], F.lit(default))

    n_test, n_dev = size(0, test), size(1, dev)
    held_out = max([test + dev, *[t + d for t, d in sizes.values()]])
    # only the held-out ranks are needed: the other rows are train and never shuffled
    placed = hash_rank(df.select(dataset, id_col), [dataset], hash_key(id_col, seed=str(seed)), held_out, "_place")
    return join_small(df, placed, [dataset, id_col], "left").withColumn(
        "split", F.when(F.col("_place") <= n_test, "test")
        .when(F.col("_place") <= n_test + n_dev, "dev").otherwise("train")).drop("_place")


def recut_splits(df: DataFrame, id_col: str, split: str = "split", test: int = TEST_SIZE, dev: int = DEV_SIZE,
                 seed: int = 123) -> DataFrame:
    """Given splits: dev rows top the test set up to ``test`` rows, ``dev`` rows stay, the rest is extra_dev."""
    have = df.where(F.col(split) == "test").agg(F.count(F.lit(1)).alias("n"))
    devs = hash_rank(df.where(F.col(split) == "dev"), [split], hash_key(id_col, seed=str(seed)), None, "_place")
    need = F.greatest(F.lit(test) - F.col("_have"), F.lit(0))
    moved = devs.withColumn("_have", have.scalar()).withColumn(
        "new_split", F.when(F.col("_place") <= need, "test")
        .when(F.col("_place") <= need + dev, "dev").otherwise("extra_dev")).drop("_place", "_have")
    return df.where(F.col(split) != "dev").withColumn("new_split", F.col(split)).unionByName(moved)


def learning_curve(df: DataFrame, id_col: str, dataset: str, sizes: Sequence[int] = tuple(CURVE_SIZES),
                   seeds: int = CURVE_SEEDS, lang: str = "lang", full_language: str = "en",
                   other_max: int = OTHER_LANGUAGE_MAX, columns: Sequence[str] = ()) -> DataFrame:
    """Training samples for every (dataset, size, seed) in one job.

    One hash order per seed serves all sizes: a smaller sample is a prefix of a larger one. Only
    sizes below the dataset size are drawn, and only ``full_language`` goes beyond ``other_max``.
    """
    rows = df.select(id_col, dataset, lang, *columns).withColumn(
        "seed", F.explode(F.array(*[F.lit(s) for s in range(1, seeds + 1)])))
    key = hash_key(F.col(id_col), F.col("seed"), seed="curve")
    ranked = hash_rank(rows, [dataset, "seed"], key, max(sizes), "_place")
    totals = df.groupBy(dataset).agg(F.count(F.lit(1)).alias("_total"))
    ranked = join_small(ranked, totals, [dataset])
    out = ranked.withColumn("n", F.explode(F.array(*[F.lit(n) for n in sizes])))
    allowed = (F.col(lang) == full_language) | (F.col("n") <= other_max)
    return (out.where((F.col("_place") <= F.col("n")) & (F.col("n") < F.col("_total")) & allowed)
            .drop("_place", "_total"))


def shuffle_rows(df: DataFrame, id_col: str, seed: int = 123, name: str = "position") -> DataFrame:
    """A seeded shuffle as an explicit 1-based position."""
    return hash_rank(df.withColumn("_all", F.lit(0)), ["_all"], hash_key(id_col, seed=str(seed)), None, name).drop("_all")
