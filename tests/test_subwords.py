"""Distinct sub-word pieces against the tokenizer's own output, and as a criterion of the weighted score."""

import os

import pytest
from pyspark.sql import functions as F

from fewlabel.functions.subwords import unique_pieces
from fewlabel.operators.selection import weighted_score

MODEL = os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), "piece_bpe_32k.model")
sentencepiece = pytest.importorskip("sentencepiece")
pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="no vocabulary file")

TEXTS = ["the cat and the other cat", "", " \n ", None, "unbelievably unbelievable", "日本語 🙂🙂 é", "same same same", "same same same",
         "long words " * 20_000]


def test_counts(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").repartition(3)
    encoder = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = {i: None if t is None else len(set(encoder.encode(t, out_type=str))) for i, t in enumerate(TEXTS)}
    got = {r["id"]: r["n"] for r in rows.select("id", unique_pieces("text", MODEL).alias("n")).collect()}
    assert got == want and got[1] == 0 and got[6] < got[0]
    assert rows.limit(0).select(unique_pieces("text", MODEL).alias("n")).count() == 0


def test_pieces_as_a_criterion(spark):
    """More distinct pieces, a lower score; the column's own words no longer matter."""
    rows = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(TEXTS) if t], "id long, text string, distance double")
    counted = rows.withColumn("unique_pieces", unique_pieces("text", MODEL))
    out = weighted_score(counted, "distance", {"unique_pieces": 1.0})
    by_score = [r["unique_pieces"] for r in out.orderBy("score", F.desc("unique_pieces")).collect()]
    assert by_score == sorted(by_score, reverse=True) and by_score[0] > by_score[-1]
