"""Unions that make training sets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fewlabel.functions.ordering import top_per_group
from fewlabel.operators.joins import join_small


def with_metadata(df: DataFrame, **values: str) -> DataFrame:
    """Attach literal columns such as split, source or language where they are absent."""
    for name, value in values.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(value))
    return df


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def load_many(frames: Sequence[tuple[str, str, DataFrame]], max_samples: int | None = None,
              order: str = "row_idx", split: str = "split") -> DataFrame:
    """(name, language, rows) triples as one table with ``dataset_name, language, dataset_pos``;
    each train split is cut to its first ``max_samples`` rows."""
    table = union_all([with_metadata(df, dataset_name=name, language=lang).withColumn("dataset_pos", F.lit(i))
                       for i, (name, lang, df) in enumerate(frames)])
    if not max_samples:
        return table
    train = top_per_group(table.where(F.col(split) == "train"), ["dataset_pos"], [order], max_samples, "_place")
    return table.where(F.col(split) != "train").unionByName(train.drop("_place"))


def union_splits(df: DataFrame, only: Sequence[str] | None = None, split: str = "split",
                 position: str = "dataset_pos") -> DataFrame:
    """Splits united over all datasets; with ``only``, the other splits keep the rows of the
    last dataset that has them."""
    if not only:
        return df
    last = df.groupBy(split).agg(F.max(position).alias("_last"))
    return (join_small(df, last, [split])
            .where(F.col(split).isin(list(only)) | (F.col(position) == F.col("_last"))).drop("_last"))


def training_rows(retrieved: DataFrame) -> DataFrame:
    """Retrieved rows as training rows."""
    return retrieved.select("text", "label", "score", F.col("lang").alias("language"))


def repeat_rows(df: DataFrame, times: int, name: str = "copy") -> DataFrame:
    """Bag union of the rows with themselves."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(max(times, 1)))))


def combine_train(target: DataFrame, retrieved: DataFrame, repeat: int = 1) -> DataFrame:
    """Target rows (source 0, score 0, repeated) and retrieved rows (source 1) under the target's types."""
    base = target.withColumn("source", F.lit(0)).withColumn("score", F.lit(0.0))
    extra = retrieved.withColumn("source", F.lit(1))
    extra = extra.select(*[F.col(f.name).cast(f.dataType) for f in base.schema.fields])
    return repeat_rows(base, repeat).drop("copy").unionByName(extra)


def target_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("source") == 0)


def retrieved_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("source") == 1)
