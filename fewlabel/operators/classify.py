"""Classifiers on vector columns: signals, class and source weights, curriculum, two-stage transfer."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fewlabel.functions.signals import entropy, margin
from fewlabel.functions.vectors import arg_max
from fewlabel.operators import curriculum
from fewlabel.operators.metrics import class_weights, classification_metrics


def fit(df: DataFrame, vec: str = "embedding", label: str = "label", weight: str | None = None,
        reg: float = 0.01, max_iter: int = 25) -> LogisticRegressionModel:
    lr = LogisticRegression(featuresCol="features", labelCol="y", regParam=reg, maxIter=max_iter)
    data = df.select(array_to_vector(vec).alias("features"), F.col(label).cast("double").alias("y"),
                     F.col(weight).alias("w") if weight else F.lit(1.0).alias("w"))
    return lr.setWeightCol("w").fit(data)


def score(model, df: DataFrame, vec: str = "embedding", name: str = "probs") -> DataFrame:
    """Add class probabilities and the predicted class."""
    out = model.transform(df.withColumn("features", array_to_vector(vec)))
    return (out.withColumn(name, vector_to_array("probability"))
            .withColumn("pred", arg_max(F.col(name)))
            .drop("features", "rawPrediction", "probability", "prediction"))


def evaluate_splits(model, df: DataFrame, by=("split",), vec: str = "embedding") -> DataFrame:
    """Score all rows once and report the metrics of every split."""
    return classification_metrics(score(model, df, vec), by=list(by))


def uncertainty_signals(model, df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Add ``uncertainty`` (entropy) and ``margin`` of the predicted distribution."""
    return (score(model, df, vec).withColumn("uncertainty", entropy(F.col("probs")))
            .withColumn("margin", margin(F.col("probs"))))


def train_weighted(train: DataFrame, evaluation: DataFrame | None = None, **kw) -> LogisticRegressionModel:
    """Balanced class weights; the evaluation labels stand in when train has one class."""
    weights = class_weights(train, evaluation).select("label", "weight")
    return fit(train.join(F.broadcast(weights), "label"), weight="weight", **kw)  # one row per class


def source_weights(train: DataFrame, retrieved_weight: float) -> DataFrame:
    """Row weights whose weighted sum is mean(target loss) + w * mean(retrieved loss)."""
    counts = train.agg(F.struct(F.count(F.when(F.col("source") == 0, 1)).alias("m"),
                                F.count(F.when(F.col("source") == 1, 1)).alias("n")).alias("c"))
    return (train.withColumn("_c", counts.scalar())
            .withColumn("weight", F.when(F.col("source") == 0, 1.0 / F.greatest(F.col("_c.m"), F.lit(1)))
                        .otherwise(F.lit(retrieved_weight) / F.greatest(F.col("_c.n"), F.lit(1))))
            .drop("_c"))


def train_source_weighted(train: DataFrame, retrieved_weight: float, **kw) -> LogisticRegressionModel:
    return fit(source_weights(train, retrieved_weight), weight="weight", **kw)


def curriculum_weights(train: DataFrame, epochs: int, schedule: str, key: str = "id") -> DataFrame:
    """Row weight = number of epochs the row is part of."""
    seen = (curriculum.slices(train.select(key, "source", "score"), epochs, schedule, key)
            .groupBy("source", key).agg(F.count(F.lit(1)).cast("double").alias("weight")))
    return train.join(seen, ["source", key])


def train_curriculum(train: DataFrame, epochs: int, schedule: str, key: str = "id", **kw):
    return fit(curriculum_weights(train, epochs, schedule, key), weight="weight", **kw)


def stack_probability(model, df: DataFrame, vec: str = "embedding", name: str = "stacked") -> DataFrame:
    """Append the first-stage probability to the vector."""
    scored = score(model, df, vec, "_p")
    return (scored.withColumn(name, F.concat(F.col(vec).cast("array<double>"), F.array(F.col("_p")[1])))
            .drop("_p", "pred"))


def two_stage(first: DataFrame, second: DataFrame, evaluation: DataFrame, vec: str = "embedding", **kw) -> DataFrame:
    """Train on the first set, carry its verdict as a feature into a fit on the second, score the last."""
    stage1 = fit(first, vec, **kw)
    stage2 = fit(stack_probability(stage1, second, vec), "stacked", **kw)
    return score(stage2, stack_probability(stage1, evaluation, vec), "stacked").drop("stacked")
