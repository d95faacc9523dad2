"""Text to vectors with Spark ML, or with a caller's encoder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fewlabel.session import spread


def tfidf_pipeline(text: str = "text", dims: int = 256) -> Pipeline:
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_tok", pattern=r"\s+"),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dims),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_unit")])


def embed(df: DataFrame, text: str = "text", name: str = "embedding", dims: int = 256,
          encoder: Callable | None = None) -> DataFrame:
    """Add an ``array<float>`` column.

    Default: hashed TF-IDF, scaled to unit length. ``encoder`` maps an iterator of pandas
    series of texts to an iterator of series of float lists and is set up once per task.
    """
    if encoder is not None:
        coded = F.pandas_udf(encoder, T.ArrayType(T.FloatType()))
        return df.withColumn(name, coded(F.col(text)))
    safe = spread(df).withColumn(text, F.coalesce(F.col(text), F.lit("")))
    model = tfidf_pipeline(text, dims).fit(safe)
    return (model.transform(safe).withColumn(name, vector_to_array("_unit", "float32"))
            .drop("_tok", "_tf", "_idf", "_unit"))
