"""The given tables and the relations the queries derive from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fewlabel.operators.joins import only_keys

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "conversations": "conv_id long, turn long, role string, text string",
    "benchmark": "item_id long, text string",
    "pages": "page_id long, url string, html string",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def labelled(spark, sf, among: DataFrame | None = None) -> DataFrame:
    """Documents with a label, of those in ``among`` if given."""
    d = table(spark, sf, "documents")
    d = d if among is None else only_keys(d, among, "doc_id")
    l = table(spark, sf, "labels")
    return d.join(l, "doc_id").withColumn("label", F.col("toxic"))


def with_vectors(spark, sf) -> DataFrame:
    """Labelled documents with a vector: ``doc_id, text, lang, source, label, quality, embedding``."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding",
                                              F.col("label").alias("topic"))
    both = v.select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return labelled(spark, sf, both).join(v, "doc_id")


def target_queries(rows: DataFrame, lang: str = "es") -> DataFrame:
    return rows.where(F.col("lang") == lang).select(
        F.col("doc_id").alias("query_id"), F.col("embedding").alias("query_vec"))


def predictions(spark, sf) -> DataFrame:
    """A verdict per labelled document: short texts are unreadable answers, else the inverse quality."""
    return labelled(spark, sf).withColumn(
        "pred", F.when(F.col("n_chars") < 700, -1).otherwise(1 - F.col("quality")).cast("int"))


def probabilities(spark, sf) -> DataFrame:
    """Class shares per vector: all components squared and normalised."""
    p = F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))
    e = table(spark, sf, "embeddings").withColumn("sq", p)
    mass = F.aggregate("sq", F.lit(0.0), lambda a, x: a + x)
    return e.withColumn("probs", F.transform("sq", lambda x: x / mass)).drop("sq")


def runs(spark, sf) -> DataFrame:
    """A run per (source, size, seed): labelled documents fall into three size classes and five seeds,
    and each group's agreement is its score."""
    size = F.when(F.col("n_chars") < 1000, "10").when(F.col("n_chars") < 3000, "100").otherwise("1000")
    seed = F.concat(F.lit("rs"), (F.ascii(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1)) % 5 + 1).cast("string"))
    return (labelled(spark, sf).withColumn("size", size).withColumn("seed", seed)
            .groupBy("source", "size", "seed")
            .agg(F.avg((F.col("quality") != F.col("label")).cast("double")).alias("f1_macro")))


# --- the same relations as SQL ------------------------------------------------------------

LABELLED = "SELECT d.*, l.quality, l.toxic, l.toxic AS label FROM documents d JOIN labels l USING (doc_id)"
WITH_VECTORS = (f"SELECT b.*, e.embedding::DOUBLE[] AS v, e.label AS topic FROM ({LABELLED}) b "
                "JOIN embeddings e ON e.vec_id = b.doc_id")
PREDICTIONS = f"SELECT *, CASE WHEN n_chars < 700 THEN -1 ELSE 1 - quality END AS pred FROM ({LABELLED})"
PROBABILITIES = """SELECT vec_id, label, [x / list_reduce(s, lambda a, b: a + b) FOR x IN s] AS probs FROM (
  SELECT vec_id, label, [x * x FOR x IN embedding::DOUBLE[]] AS s FROM embeddings)"""
RUNS = f"""SELECT source, CASE WHEN n_chars < 1000 THEN '10' WHEN n_chars < 3000 THEN '100' ELSE '1000' END AS size,
  'rs' || (ascii(substr(md5(doc_id::VARCHAR), 1, 1)) % 5 + 1)::VARCHAR AS seed,
  avg(CASE WHEN quality <> label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS f1_macro
  FROM ({LABELLED}) GROUP BY 1, 2, 3"""


def sql_l2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def sql_dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"


def sql_norm(a: str) -> str:
    return f"sqrt(list_sum([x * x FOR x IN {a}]))"
