"""Classification metrics as plain aggregations over a confusion table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INVALID = -1  # an answer that could not be read


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion_counts(df: DataFrame, label: str = "label", pred: str = "pred",
                     by: Sequence[str] = ()) -> DataFrame:
    """True and false positives and negatives for class 1; invalid answers count in none of them."""
    l, p = F.col(label), F.col(pred)
    return df.groupBy(*by).agg(
        F.count_if((p == 1) & (l == 1)).alias("true_positives"),
        F.count_if((p == 1) & (l == 0)).alias("false_positives"),
        F.count_if((p == 0) & (l == 1)).alias("false_negatives"),
        F.count_if((p == 0) & (l == 0)).alias("true_negatives"))


def per_class(df: DataFrame, label: str = "label", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """Support, precision, recall and F1 of every class seen as label or prediction."""
    by = list(by)
    cells = df.groupBy(*by, label, pred).agg(F.count(F.lit(1)).alias("_cell"))
    hit = F.when(F.col(label) == F.col(pred), F.col("_cell")).otherwise(F.lit(0))
    sides = F.array(
        F.struct(F.col(label).cast("int").alias("cls"), F.col("_cell").alias("support"),
                 F.lit(0).cast("long").alias("predicted"), hit.cast("long").alias("tp")),
        F.struct(F.col(pred).cast("int").alias("cls"), F.lit(0).cast("long").alias("support"),
                 F.col("_cell").alias("predicted"), F.lit(0).cast("long").alias("tp")))
    sums = (cells.select(*by, F.inline(sides)).groupBy(*by, "cls")
            .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")]))
    precision, recall = _ratio(F.col("tp"), F.col("predicted")), _ratio(F.col("tp"), F.col("support"))
    return (sums.withColumn("precision", precision).withColumn("recall", recall)
            .withColumn("f1", _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"))))


def classification_metrics(df: DataFrame, label: str = "label", pred: str = "pred",
                           by: Sequence[str] = ()) -> DataFrame:
    """One row of metrics per ``by`` group.

    ``f1_macro`` averages over every class present, the invalid class included;
    ``f1_macro_valid`` leaves invalid out. Class-1 figures are looked up by label.
    """
    classes = per_class(df, label, pred, by)
    one, valid = F.col("cls") == 1, F.col("cls") != INVALID

    def of_one(c):
        return F.coalesce(F.max(F.when(one, F.col(c))), F.lit(0).cast("double"))

    def weighted(c):
        return F.sum(F.col(c) * F.col("support")) / F.sum("support")

    n1 = lambda c: F.coalesce(F.max(F.when(one, F.col(c))), F.lit(0)).cast("long")
    rates = classes.groupBy(*by).agg(
        F.sum("support").cast("long").alias("n"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("f1_macro"),
        F.avg(F.when(valid, F.col("f1"))).alias("f1_macro_valid"),
        weighted("f1").alias("f1_weighted"),
        weighted("precision").alias("precision_weighted"),
        weighted("recall").alias("recall_weighted"),
        of_one("precision").alias("precision_1"),
        of_one("recall").alias("recall_1"),
        of_one("f1").alias("f1_1"),
        n1("support").alias("support_1"),
        F.coalesce(F.sum(F.when(~valid, F.col("predicted"))), F.lit(0)).cast("long").alias("n_invalid"))
    return rates


def class_weights(df: DataFrame, fallback: DataFrame | None = None, label: str = "label") -> DataFrame:
    """n / (classes * n_c) per class; when the training rows hold a single class the
    evaluation rows take their place."""
    def sized(rows):
        return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))

    def weighed(sizes):
        total = sizes.agg(F.struct(F.sum("n").alias("n"), F.count(F.lit(1)).alias("c")).alias("t"))
        t = F.col("_t")
        return (sizes.withColumn("_t", total.scalar())
                .withColumn("weight", t["n"].cast("double") / (t["c"] * F.col("n")))
                .withColumn("_classes", t["c"]).drop("_t"))

    own = weighed(sized(df))
    if fallback is None:
        return own.drop("_classes")
    single = sized(df).agg((F.count(F.lit(1)) < 2).alias("s"))
    other = weighed(sized(fallback)).withColumn("_single", single.scalar())
    return (own.where(F.col("_classes") >= 2).drop("_classes")
            .unionByName(other.where("_single").drop("_single", "_classes")))
