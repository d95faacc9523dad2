"""Queries that fit a Spark ML model; their values depend on the fit, so they have no SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from fewlabel.functions.vectors import as_double, norm
from fewlabel.operators import classify, gradient
from fewlabel.operators.embed import embed
from fewlabel.operators.metrics import classification_metrics
from fewlabel.plans.registry import query, rnd
from fewlabel.plans.tables import table, with_vectors


def _rows(spark, sf):
    """All labelled rows; ``held_out`` is a quarter of them by a digest of the id."""
    x = with_vectors(spark, sf).select("doc_id", "lang", "label", "embedding", "text", "n_chars")
    return x.withColumn("held_out", F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1).isin("0", "1", "2", "3"))


def _training(rows):
    """The rows that are not held out (source 0 = es, 1 = retrieved)."""
    return (rows.where(~F.col("held_out")).drop("held_out").withColumn("source", (F.col("lang") != "es").cast("int"))
            .withColumn("score", F.col("n_chars") / 1000.0).withColumnRenamed("doc_id", "id"))


def _sets(spark, sf):
    """Training rows and the held-out quarter to score."""
    x = _rows(spark, sf)
    return _training(x), x.where("held_out").drop("held_out")


def _evaluated(model, rows):
    m = classify.evaluate_splits(model, rows, ["lang"])
    return m.select("lang", "n", rnd("accuracy").alias("accuracy"), rnd("f1_macro").alias("f1_macro"))


@query("embed_text", "SELECT doc_id, 128 AS dims, 1.0::DOUBLE AS length FROM documents")
def q_embed(spark, sf):
    """Every text gets one vector of unit length; that much has a SQL twin."""
    d = embed(table(spark, sf, "documents").select("doc_id", "text"), dims=128)
    return d.select("doc_id", F.size("embedding").alias("dims"), rnd(norm(as_double("embedding")), 4).alias("length"))


@query("uncertainty_signals")
def q_uncertainty(spark, sf):
    """Signals for every labelled row; those that are not ``held_out`` were fitted on."""
    rows = _rows(spark, sf)
    out = classify.uncertainty_signals(classify.fit(_training(rows)), rows)
    return out.select("doc_id", "held_out", "pred", rnd("uncertainty").alias("uncertainty"), rnd("margin").alias("margin"))


@query("train_weighted")
def q_weighted(spark, sf):
    train, rows = _sets(spark, sf)
    return _evaluated(classify.train_weighted(train, rows), rows)


@query("train_source_weighted")
def q_source_weighted(spark, sf):
    train, rows = _sets(spark, sf)
    return _evaluated(classify.train_source_weighted(train, 0.3), rows)


@query("train_curriculum")
def q_train_curriculum(spark, sf):
    train, rows = _sets(spark, sf)
    return _evaluated(classify.train_curriculum(train, 5, "linear"), rows)


@query("two_stage")
def q_two_stage(spark, sf):
    train, rows = _sets(spark, sf)
    scored = classify.two_stage(train.where("source = 1"), train.where("source = 0"), rows)
    m = classification_metrics(scored, by=["lang"])
    return m.select("lang", "n", rnd("accuracy").alias("accuracy"), rnd("f1_macro").alias("f1_macro"))


def _by_language(scored):
    m = classification_metrics(scored, by=["lang"])
    return m.select("lang", "n", rnd("accuracy").alias("accuracy"), rnd("f1_macro").alias("f1_macro"))


@query("predict_splits")
def q_predict_splits(spark, sf):
    """One model scored on the test rows, the functional cases and every country's slice of them."""
    train, rows = _sets(spark, sf)
    digit = F.ascii(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1)) % 3
    rows = rows.withColumn("split", F.when(digit == 0, "test").when(digit == 1, "hate_check").otherwise("hate_day"))
    rows = rows.withColumn("country", F.when(F.col("split") == "hate_day", F.col("lang")))
    m = classify.evaluate_splits(classify.train_weighted(train, rows), rows, ["split", "country"])
    return m.select("split", "country", "n", rnd("accuracy").alias("accuracy"), rnd("f1_macro").alias("f1_macro"))


@query("train_in_epochs")
def q_train_in_epochs(spark, sf):
    """Curriculum training with weights that go from epoch to epoch."""
    train, rows = _sets(spark, sf)
    return _by_language(gradient.score(gradient.train_in_epochs(train, 5, "linear"), rows))


@query("continue_training")
def q_continue(spark, sf):
    """A first stage on the retrieved rows, continued on the target rows near its weights."""
    train, rows = _sets(spark, sf)
    first = gradient.fit(train.where("source = 1"))
    return _by_language(gradient.score(gradient.continue_training(first, train.where("source = 0"), pull=0.05), rows))


@query("fit_sweep")
def q_fit_sweep(spark, sf):
    train, rows = _sets(spark, sf)
    return gradient.sweep_fit(train.where("source = 1"), rows.where("lang = 'es'"), [0.001, 0.1], [10, 30]).withColumn(
        "f1_macro", rnd("f1_macro"))
