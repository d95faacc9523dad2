"""Deduplication, label balancing, caps, filters and scoring of retrieved rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fewlabel.functions.ordering import as_cols, first_per_group, hash_key, hash_rank, top_per_group
from fewlabel.functions.scaling import min_max
from fewlabel.functions.signals import CRITERION_SIGN, signed, unique_tokens


def exclude(df: DataFrame, column: str, values: Sequence | None) -> DataFrame:
    """Drop rows whose value is listed; rows without a value pass."""
    if not values:
        return df
    return df.where(F.col(column).isNull() | ~F.col(column).isin(list(values)))


def include(df: DataFrame, column: str, values: Sequence | None) -> DataFrame:
    """Keep only rows whose value is listed."""
    return df.where(F.col(column).isin(list(values))) if values else df


def dedup_two_stage(df: DataFrame, id_cols: Sequence[str], text: str, order: Sequence,
                    within: Sequence[str] = ()) -> DataFrame:
    """First occurrence by (dataset, id), then first occurrence by exact text."""
    once = first_per_group(df, [*within, *id_cols], order)
    return first_per_group(once, [*within, text], order)


def balance_labels(df: DataFrame, max_count: int, order: Sequence, label: str = "label",
                   within: Sequence[str] = ()) -> DataFrame:
    """The first m rows of each label in ``order``, m = min(n0, n1, max_count // 2), per group."""
    half = max_count // 2
    best = top_per_group(df.where(F.col(label).isin(0, 1)), [*within, label], order, half, "_place")
    sizes = [F.count(F.when(F.col(label) == v, 1)).alias(f"_n{v}") for v in (0, 1)]
    keep = F.col("_place") <= F.least("_n0", "_n1")
    if within:
        # at most max_count rows per group are left, so a window over the group is bounded
        from pyspark.sql import Window
        w = Window.partitionBy(*within)
        for v in (0, 1):
            best = best.withColumn(f"_n{v}", F.count(F.when(F.col(label) == v, 1)).over(w))
        return best.where(keep).drop("_place", "_n0", "_n1")
    counts = best.agg(F.struct(*sizes).alias("c"))
    return (best.withColumn("_c", counts.scalar())
            .where(F.col("_place") <= F.least("_c._n0", "_c._n1")).drop("_place", "_c"))


def rebalance_classes(df: DataFrame, negatives: dict[str, int], id_col: str, dataset: str,
                      label: str = "label", seed: int = 123) -> DataFrame:
    """All positives and an exact-size hash sample of the negatives of each listed dataset;
    datasets that are not listed stay whole."""
    listed = F.create_map(*[F.lit(x) for kv in negatives.items() for x in kv])
    cap = F.coalesce(listed[F.col(dataset)], F.lit(2**31 - 1))
    is_capped = F.col(dataset).isin(list(negatives)) & (F.col(label) == 0)
    rest = df.where(~F.coalesce(is_capped, F.lit(False)))
    capped = hash_rank(df.where(is_capped), [dataset], hash_key(id_col, seed=str(seed)),
                       max(negatives.values()), "_place").where(F.col("_place") <= cap)
    return rest.unionByName(capped.drop("_place"))


def cap_rows(df: DataFrame, condition: Column, groups: Sequence[str], order: Sequence, n: int) -> DataFrame:
    """Rows that meet ``condition`` are kept only up to the first ``n`` per group in ``order``."""
    met = F.coalesce(condition, F.lit(False))
    capped = top_per_group(df.where(met), groups, order, n, "_place").drop("_place")
    return df.where(~met).unionByName(capped)


# --- criteria and the weighted score ------------------------------------------------------

SCORE_COLUMN = {"unique_words": "length_score", "unique_pieces": "length_score", "cluster": "cluster_score",
                "uncertainty": "uncertainty_score", "margin": "margin_score",
                "perplexity": "perplexity_score"}


def weighted_score(df: DataFrame, base: str, weights: dict[str, float], text: str = "text",
                   cluster_size: str = "cluster_size", within: Sequence[str] = ()) -> DataFrame:
    """score = (1 - sum w) * base + sum w_i * scaled criterion_i; ascending is better.

    A criterion with weight 0 is not computed; its column stays null. Lengths are counted in words of ``text``, or
    in sub-word pieces, which the column ``unique_pieces`` then holds; not in both.
    """
    active = {c: w for c, w in weights.items() if w}
    if {"unique_words", "unique_pieces"} <= set(active):
        raise ValueError("lengths are counted in words or in pieces")
    raw = {"unique_words": lambda: -unique_tokens(text).cast("double"),
           "unique_pieces": lambda: -F.col("unique_pieces").cast("double"),
           "cluster": lambda: F.col(cluster_size).cast("double"),
           **{c: (lambda c=c: signed(c)) for c in CRITERION_SIGN}}
    scaled = {}
    for c in active:
        df = df.withColumn(f"_raw_{c}", raw[c]())
        scaled[SCORE_COLUMN[c]] = f"_raw_{c}"
    if scaled:
        df = min_max(df, scaled, within or None)
    for column in dict.fromkeys(SCORE_COLUMN.values()):
        if column not in scaled:
            df = df.withColumn(column, F.lit(None).cast("double"))
    rest = 1.0 - sum(active.values())
    score = reduce(lambda acc, c: acc + F.lit(float(active[c])) * F.col(SCORE_COLUMN[c]),
                   active, F.lit(rest) * F.col(base))
    return df.withColumn("score", score).drop(*scaled.values())


def best_rows(df: DataFrame, n: int, order: Sequence) -> DataFrame:
    """The first n rows of the whole set."""
    return df.orderBy(*as_cols(order)).limit(n)
