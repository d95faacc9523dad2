"""From raw documents to token ids: toxicity, near duplicates, benchmark leaks, personal data, pieces.

Every stage takes what its predecessor kept, written as Parquet and read again. ``run`` returns the last stage's rows.
Stages with Python tasks bound the Arrow batches of the session by bytes, so that long texts need bounded memory.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fewlabel.llm import decontaminate, pieces, pii, simhash, toxicity
from fewlabel.llm.common import bounded_batches
from fewlabel.plans.tables import table
from fewlabel.session import durable

# Where the tokenizer files lie; a path of the driver.
PIECE_MODEL = os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), "piece_bpe_32k.model")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose restored text scores one half or more go. Labels come from ``labels``, but for the held-out fifth."""
    bounded_batches(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with a five-word shingle similarity of 0.8 or more the row with the smallest id stays."""
    bounded_batches(spark)
    return simhash.keep_representatives(docs, width=5, similarity=0.8)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain a benchmark item go."""
    bounded_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; personal data in its text is replaced by its kind, and ``n_chars`` follows where text changed."""
    return pii.mask(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_ids, ids, round_trip``: the ids of the whole text, and whether they decode to it again."""
    bounded_batches(spark)
    coded = pieces.encode(docs, PIECE_MODEL, verify=True)
    return coded.select("doc_id", F.size("ids").alias("n_ids"), "ids", "round_trip")


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_copies), ("decontamination", drop_leaks),
          ("personal_data", mask_personal), ("pieces", encode_pieces)]

# A learned score, fingerprints and piece ids cannot be written in SQL; tests hold the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
