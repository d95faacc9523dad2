"""Secrets: fixed patterns, and character Markov models of random strings and ordinary identifiers.

Two bigram models are trained from labelled samples by counting; a candidate string is a secret when the mean
log-likelihood ratio per character speaks for the random model. Training and scanning are column expressions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fewlabel.llm.common import locate, text_of

# Base kinds and how long a match, or its named part, must be.
ASSIGN = (r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
          r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*+[:=]\x20*+[\"']?)([A-Za-z0-9+/_.=-]++)")
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
ASSIGN_LEAST = 6

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"
ORDINARY = r"[A-Za-z0-9+/_=-]{12,}+"
STATES = len(ALPHABET) + 1  # the last state stands before the first character
THRESHOLD = 0.7
BACKING = 20.0  # weight of a character's own share against what was seen after the one before


def _steps(value: Column) -> Column:
    """The cells ``from * STATES + to`` a string passes through; characters outside the alphabet count as the start."""
    def at(i):
        return F.when(i < 1, F.lit(STATES - 1)).otherwise(
            (F.position(F.substring(value, i, F.lit(1)), F.lit(ALPHABET)) - 1 + STATES) % STATES)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(value), F.lit(1))), lambda i: at(i - 1) * STATES + at(i))


def fit_markov(samples: DataFrame, sample_col: str = "sample", label_col: str = "label", prior: float = 1.0) -> np.ndarray:
    """Log-likelihood ratio per character step, random against ordinary, as a flat ``STATES * STATES`` table.

    ``samples`` holds strings with label 1 (random) or 0 (ordinary); others, nulls and empty strings are left out.
    All samples are counted, pre-aggregated per task; only the counts reach the driver (at most ``2 * STATES**2`` rows).
    A step is backed by its character's own share, and that by ``prior`` for every character, so without samples every
    ratio is zero.
    """
    rows = samples.where((F.length(sample_col) > 0) & F.col(label_col).isin(0, 1)).select(
        F.col(label_col).cast("int").alias("label"), F.explode(_steps(F.col(sample_col))).alias("cell"))
    counts = np.zeros((2, STATES, STATES))
    for r in rows.groupBy("label", "cell").count().collect():
        counts[r["label"]].flat[r["cell"]] = r["count"]
    shares = (counts.sum(axis=1) + prior) / (counts.sum(axis=(1, 2))[:, None] + prior * STATES)
    steps = counts + BACKING * shares[:, None, :]
    logs = np.log(steps / steps.sum(axis=2, keepdims=True))
    return (logs[1] - logs[0]).ravel()


# What a text must contain for a pattern to match, which is cheaper to see.
NEEDS = {ASSIGN: "[:=]", ACCESS: "AKIA"}


def _all(text: str, pattern: str, group: int = 0) -> Column:
    hits = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group))
    return F.when(F.col(text).rlike(NEEDS[pattern]), hits).otherwise(
        F.array().cast("array<string>")) if pattern in NEEDS else hits


def document_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = 200) -> DataFrame:
    """Labelled samples drawn from a corpus: ``sample, label``.

    Label 1: for every row random strings in four common alphabets, cut from digests of its id, and the values that
    the base patterns find in it. Label 0: its words of twelve or more characters once the base matches are taken out,
    each at most ``longest`` characters long (longer runs are encoded data rather than identifiers).
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), text_of(text_col).alias("text"))
    def digest(salt):
        return F.sha2(F.concat(F.coalesce("id", F.lit("")), F.lit(salt)), 256)
    random = F.array(digest("a"), F.base64(F.unhex(digest("b"))),
                     F.substring(F.translate(F.base64(F.unhex(digest("c"))), "+/=", ""), 1, 40),
                     F.concat(F.lit("AKIA"), F.substring(F.translate(F.upper(F.base64(F.unhex(digest("d")))), "+/=", ""), 1, 16)))
    found = F.concat(_all("text", ASSIGN, 2), _all("text", HEX), _all("text", ACCESS))
    rows = rows.select("id", found.alias("found"), _all("text", ORDINARY).alias("words"))
    known = F.concat(random, F.col("found"))
    ordinary = F.filter("words", lambda w: (F.length(w) <= longest) & ~F.exists("found", lambda v: w.contains(v)))
    ones = F.transform(F.filter(known, lambda w: F.length(w).between(16, longest)),
                       lambda w: F.struct(w.alias("sample"), F.lit(1).alias("label")))
    zeros = F.transform(ordinary, lambda w: F.struct(w.alias("sample"), F.lit(0).alias("label")))
    return rows.select(F.inline(F.concat(ones, zeros)))


def _ratio(value: Column, table: Column) -> Column:
    total = F.aggregate(_steps(value), F.lit(0.0), lambda a, cell: a + F.get(table, cell))
    return total / F.length(value)


def find_secrets(docs: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, text_col, base, spans``: one row per input row; other columns are left out.

    ``base`` holds the spans of the three fixed patterns; ``spans`` also those of strings of twenty or more characters
    whose mean ratio under ``ratios`` (from ``fit_markov``) reaches ``THRESHOLD`` and that overlap no base span. Both
    are ``array<struct<start, rank, end, kind>>`` by start, then kind. A null text is the empty one; no hit gives empty
    arrays; repeated rows are answered once each.
    """
    text = F.col(text_col)
    table = F.lit(np.asarray(ratios, dtype="float64"))
    kinds = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "random": CANDIDATE}
    rows = docs.select(F.col(id_col), text_of(text_col).alias(text_col))
    rows = rows.select("*", *[_all(text_col, p).alias(f"_{k}") for k, p in kinds.items()])

    def spans(kind, rank, keep=None):
        spots = locate(text, F.col(f"_{kind}"), kinds[kind])
        spots = F.filter(spots, keep) if keep else spots
        return F.transform(spots, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"),
                                                     s["end"].alias("end"), F.lit(kind).alias("kind")))

    long_enough = lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= ASSIGN_LEAST
    odd = F.exists(F.col("_random"), lambda v: _ratio(v, table) >= THRESHOLD)
    rows = rows.select(
        id_col, text_col,
        F.array_sort(F.concat(spans("assign", 0, long_enough), spans("access", 1), spans("hex", 2))).alias("base"),
        F.when(odd, spans("random", 3, lambda s: _ratio(s["value"], table) >= THRESHOLD)).alias("_odd"))
    fresh = F.filter("_odd", lambda a: ~F.exists("base", lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])))
    return rows.select(id_col, text_col, "base", F.when(F.size("_odd") > 0, F.array_sort(F.concat("base", fresh)))
                       .otherwise(F.col("base")).alias("spans"))
