"""Explicit orders: hash order, ranks within groups, and exact ranks that survive hot groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fewlabel.operators.joins import join_small
from fewlabel.session import durable

# Catalyst prunes ``row_number() <= n`` before the shuffle only up to this n
# (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000


def hash_key(*cols, seed: str = "") -> Column:
    """A hex digest that orders rows the same way on every engine and every run."""
    parts = [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]
    return F.md5(F.concat_ws("-", *parts, F.lit(str(seed))))


def as_cols(names: Sequence) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


# A group known to stay below this many rows is ranked by one task.
SAFE_GROUP_ROWS = 5_000_000


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence, n: int,
                  name: str = "rank", group_rows: int | None = None) -> DataFrame:
    """The first ``n`` rows of every group with their 1-based rank.

    Small ``n``: a ranking filter, which Catalyst turns into a per-task limit ahead of the
    shuffle, so a hot group ships at most ``n`` rows per task. Large ``n``: the exact
    range-partitioned rank, unless ``group_rows`` bounds the groups.
    """
    if n > GROUP_LIMIT and (group_rows is None or group_rows > SAFE_GROUP_ROWS):
        ranked = rank_in_group(df, groups, order, name)
    else:
        ranked = df.withColumn(
            name, F.row_number().over(Window.partitionBy(*groups).orderBy(*as_cols(order))))
    return ranked.where(F.col(name) <= n)


def first_per_group(df: DataFrame, groups: Sequence[str], order: Sequence) -> DataFrame:
    """First-wins deduplication on ``groups``."""
    return top_per_group(df, groups, order, 1, "_first").drop("_first")


def rank_in_group(df: DataFrame, groups: Sequence[str], order: Sequence, name: str = "rank") -> DataFrame:
    """Exact 1-based row number per group (or over all rows when ``groups`` is empty).

    Rows are range-partitioned on (groups, order), so a group holding a third of the data
    spreads over a third of the partitions. Each (partition, group) piece knows its size;
    the running sum of those sizes gives every piece its offset.
    """
    keys = as_cols(groups)
    placed = durable(
        df.repartitionByRange(*keys, *as_cols(order))
        .sortWithinPartitions(*keys, *as_cols(order))
        .withColumn("_seq", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_seq", 33)),
        "ranked")
    pieces = (placed.groupBy("_part", *groups)
              .agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_low")))
    before = (Window.partitionBy(*groups).orderBy("_part")
              .rowsBetween(Window.unboundedPreceding, -1))
    pieces = (pieces.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    # few rows per (partition, group): usually a broadcast, so the ranked rows are not shuffled again
    return join_small(placed, pieces, ["_part", *groups]).select(
        *df.columns, (F.col("_seq") - F.col("_low") + F.col("_before") + 1).cast("long").alias(name))


# Groups up to this size are ranked by one task each; buckets of larger groups aim at a quarter of it.
PLAIN_GROUP_ROWS = 200_000


def _bucket_digits(largest: int) -> int:
    """Hex digits that cut the largest group into buckets of about 50 000 rows."""
    digits = 0
    while largest > PLAIN_GROUP_ROWS // 4 * 16 ** digits and digits < 5:
        digits += 1
    return digits if largest > PLAIN_GROUP_ROWS else 0


def hash_rank(df: DataFrame, groups: Sequence[str], key: Column, limit: int | None = None,
              name: str = "rank") -> DataFrame:
    """Exact rank of rows in hash order within each group, kept up to ``limit``.

    Where a group is large, the leading hex digits of the digest cut the groups into even
    buckets. Bucket counts give the rank offset of each bucket; buckets that start beyond
    ``limit`` are dropped before any row is shuffled for ranking.
    """
    groups = list(groups)
    largest = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    digits = _bucket_digits(largest)
    keyed = df.withColumn("_key", key)
    if digits:
        keyed = keyed.withColumn("_bucket", F.substring("_key", 1, digits))
        sizes = keyed.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        before = (Window.partitionBy(*groups).orderBy("_bucket")
                  .rowsBetween(Window.unboundedPreceding, -1))
        offsets = (sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
                   .drop("_n"))
        if limit is not None:
            offsets = offsets.where(F.col("_before") < limit)
        keyed = join_small(keyed, offsets, [*groups, "_bucket"])
        within, offset = [*groups, "_bucket"], F.col("_before")
    else:
        within, offset = groups, F.lit(0)
    place = F.row_number().over(Window.partitionBy(*within).orderBy("_key"))
    if limit is not None and not digits:
        return keyed.withColumn(name, place).where(F.col(name) <= limit).select(
            *df.columns, F.col(name).cast("long").alias(name))
    ranked = keyed.withColumn(name, (offset + place).cast("long"))
    if limit is not None:
        ranked = ranked.where(F.col(name) <= limit)
    return ranked.select(*df.columns, name)
