"""Language model scores: a hashed maximum-entropy model over word classes, beside exact smoothed unigrams.

A token's probability is that of its class given the words before, times its share of the class. The class factor is a
softmax over hashed n-gram and skip features, trained by gradient steps inside the tasks whose weights are averaged between
rounds; the share comes from exact counts of all training tokens. Classes part the vocabulary (the most frequent words
alone, the others by frequency), so the probabilities of all known tokens and one unknown per class sum to one.
"""

from __future__ import annotations

import math
from collections import Counter
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fewlabel.llm.common import frame, held_out, largest, text_of
from fewlabel.session import durable

BANDS = 6  # classes that hold many words: five bands of frequency and the words that do not travel
LEAST_BITS = 11
BATCH = 16_384  # tokens per gradient step at least; tables with more buckets take larger steps
ROUNDS = 2
SLICE = 1_000_000  # characters worked on at a time
SMOOTH = 0.1
END = ""  # the end token; no word is empty
BLOCK = 2_048  # buckets per row when weights travel
UNKNOWN = -1


def tokens(text: str) -> list[bytes]:
    """Words by ASCII white space with ASCII letters in lower case, then the end token."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    words.append(b"")
    return words


def _slices(batch: pd.DataFrame):
    ends = batch["text"].str.len().cumsum() // SLICE
    for _, part in batch.groupby(ends, sort=False):
        yield part


def count_words(docs: DataFrame) -> DataFrame:
    """``word, n`` over all tokens of ``text``: counted in the tasks, then summed per word."""
    def count(batches):
        total: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                total.update(tokens(text))
                if len(total) > 400_000:
                    yield _counted(total)
                    total = Counter()
        yield _counted(total)

    return docs.select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(total: Counter) -> pd.DataFrame:
    return frame({"word": [w.decode("utf-8", "replace") for w in total], "n": np.fromiter(total.values(), dtype=np.int64, count=len(total))})


class Size:
    """How large the model is for ``n`` training tokens; it grows with them and has no upper bound.

    The buckets and the words that travel with the tasks grow with the square root of ``n``, the classes with its
    logarithm: 15 million tokens give 2^15 buckets, 31 000 words and 18 classes, 4.5 billion 2^20, 536 000 and 26. A task
    holds classes x buckets weights of four bytes (the larger case: 109 MB).
    """

    def __init__(self, n: int):
        doublings = math.log2(max(n, 2))
        self.bits = max(LEAST_BITS, math.ceil(doublings / 2) + 3)
        self.buckets = 1 << self.bits
        self.batch = max(BATCH, self.buckets)
        self.classes = BANDS + max(2, round(doublings) - BANDS - 6)
        self.frequent = 8 * math.isqrt(max(n, 1))


class Vocabulary:
    """The frequent words with their counts and classes, and the corpus totals."""

    def __init__(self, frequent: list[tuple[str, int]], n: int, v: int):
        self.n, self.v, self.size = n, v, Size(n)
        classes, single = self.size.classes, self.size.classes - BANDS
        self.ids = {w.encode("utf-8"): i for i, (w, _) in enumerate(frequent)}
        counts = np.array([c for _, c in frequent], dtype=float)
        self.logs = np.append(np.log10(counts + SMOOTH), 0.0)  # the last entry is for words not in here
        kinds = np.arange(len(counts))
        rest = counts[single:]
        if len(rest):
            share = (np.cumsum(rest) - rest / 2) / rest.sum()
            kinds[single:] = single + np.minimum((share * (BANDS - 1)).astype(int), BANDS - 2)
        self.kinds = np.append(kinds, classes - 1).astype(np.int64)
        mass = np.bincount(self.kinds[:-1], weights=counts + SMOOTH, minlength=classes) + SMOOTH
        mass[-1] = n - counts.sum() + SMOOTH * (v - len(counts)) + SMOOTH
        self.mass = np.log10(mass)
        self.prior = np.log(mass / mass.sum()).astype(np.float32)


def _hash(values: np.ndarray, salt: int, bits: int) -> np.ndarray:
    mixed = (values + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)).astype(np.int64)


def _features(words: list[bytes], lengths: np.ndarray, bits: int) -> np.ndarray:
    """Buckets of four features per token: the word before, the one before that, both, and the third before."""
    codes = np.fromiter(map(crc32, words), dtype=np.uint64, count=len(words)) + np.uint64(1)
    place = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    back = []
    for step in (1, 2, 3):
        moved = np.zeros_like(codes)
        moved[step:] = codes[:-step]
        moved[place < step] = 0
        back.append(moved)
    one, two, three = back
    salted = ((one, 1), (two, 2 << 33), (one * np.uint64(1_000_003) + two, 3 << 33), (three, 4 << 33))
    return np.stack([_hash(values, salt, bits) for values, salt in salted])


def _probabilities(weights: np.ndarray, prior: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Class probabilities, one column per token."""
    logits = np.take(weights, features[0], axis=1)
    for f in features[1:]:
        logits += np.take(weights, f, axis=1)
    logits += prior[:, None]
    logits -= logits.max(axis=0)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=0)
    return logits


def _step(weights: np.ndarray, prior: np.ndarray, features: np.ndarray, kinds: np.ndarray, rate: float) -> np.ndarray:
    """One gradient step in place: a feature moves against the mean error of the tokens that have it. Returns its uses."""
    error = _probabilities(weights, prior, features)
    error[kinds, np.arange(len(kinds))] -= 1
    buckets = weights.shape[1]
    flat = features.ravel()
    uses = np.bincount(flat, minlength=buckets)
    scale = (rate / (uses + 4.0)).astype(np.float32)
    for c in range(len(weights)):
        weights[c] -= np.bincount(flat, weights=np.tile(error[c], len(features)), minlength=buckets).astype(np.float32) * scale
    return uses


def _encoded(part: pd.DataFrame, vocabulary: Vocabulary):
    words, lengths = [], []
    for text in part["text"]:
        own = tokens(text)
        words += own
        lengths.append(len(own))
    lengths = np.array(lengths, dtype=np.int64)
    get = vocabulary.ids.get
    ids = np.fromiter((get(w, UNKNOWN) for w in words), dtype=np.int64, count=len(words))
    return words, lengths, ids


def train(docs: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS, rate: float = 0.7) -> np.ndarray:
    """Class weights ``classes x buckets``, as many as the vocabulary's ``size`` says. Every row of ``docs`` (``text``) is trained on in exactly one round.

    A task starts from the weights of the round before and takes gradient steps over its rows; a feature's new weight is
    the mean over the tasks, weighed by how often each saw it. Tasks send rows of fixed size (their weights in sum)
    that are added up per block of buckets in a stream; the driver holds one set of weights.
    """
    size = vocabulary.size
    buckets, classes = size.buckets, size.classes
    weights = np.zeros((classes, buckets), dtype=np.float32)
    for number in range(rounds):
        start = weights.copy()

        def learn(batches, start=start):
            own, uses = start.copy(), np.zeros(buckets, dtype=np.int64)
            for batch in batches:
                for part in _slices(batch):
                    words, lengths, ids = _encoded(part, vocabulary)
                    features, kinds = _features(words, lengths, size.bits), vocabulary.kinds[ids]
                    for at in range(0, len(kinds), size.batch):
                        now = slice(at, at + size.batch)
                        uses += _step(own, vocabulary.prior, features[:, now], kinds[now], rate)
            if uses.any():
                rows = np.concatenate([own * uses, uses[None, :]]).astype(np.float32).reshape(-1, BLOCK)
                yield frame({"block": np.arange(len(rows)), "cells": list(rows)})

        def add(batches):
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for block, cells in zip(batch["block"], batch["cells"]):
                    total[block] = total.get(block, 0.0) + cells.astype(np.float64)
            yield frame({"block": np.array(list(total), dtype=np.int64), "cells": list(total.values())})

        blocks = (classes + 1) * buckets // BLOCK
        own = docs.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == number)
        sent = own.select("text").mapInPandas(learn, "block long, cells array<float>")
        summed = sent.repartition(-(-blocks // 8), "block").mapInPandas(add, "block long, cells array<double>").collect()
        if not summed:
            continue
        table = np.zeros((blocks, BLOCK))
        for r in summed:
            table[r["block"]] = r["cells"]
        table = table.reshape(classes + 1, buckets)
        seen = table[-1] > 0
        weights[:, seen] = (table[:-1, seen] / table[-1, seen]).astype(np.float32)
    return weights


def score(docs: DataFrame, parts: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    Trains on the rows whose id is not held out and scores all of them, whole. ``base_score`` is the sum of
    ``log10((c + 0.1) / (N + 0.1 (V + 1)))`` over the tokens, ``score`` the model's log10 probability. A null text is the
    empty one, which is its end token alone; without training rows every token is unknown and both scores are zero.
    Repeated rows are trained on and answered once each. Other columns are left out.
    """
    rows = docs.select(F.col(id_col), held_out(id_col, parts).alias("held_out"), text_of(text_col).alias("text"))
    known = rows.where(~F.col("held_out"))
    counts = durable(count_words(known), "words")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = [(r["word"], r["n"]) for r in largest(counts, "n", Size(n).frequent).collect()]
    vocabulary = Vocabulary(sorted(top, key=lambda w: (-w[1], w[0])), n, v)
    weights = train(known, vocabulary)
    kind = rows.schema[id_col].dataType.simpleString()

    def rate(batches):
        for batch in batches:
            for part in _slices(batch):
                words, lengths, ids = _encoded(part, vocabulary)
                kinds, starts = vocabulary.kinds[ids], np.cumsum(lengths) - lengths
                logs = np.empty(len(ids))
                features = _features(words, lengths, vocabulary.size.bits)
                for at in range(0, len(ids), BATCH):
                    own = slice(at, at + BATCH)
                    p = _probabilities(weights, vocabulary.prior, features[:, own])
                    logs[own] = np.log10(np.maximum(p[kinds[own], np.arange(p.shape[1])], 1e-30))
                logs -= vocabulary.mass[kinds]
                rare = [[words[i].decode("utf-8", "replace") for i in np.flatnonzero(ids[a:a + size] < 0) + a]
                        for a, size in zip(starts, lengths)]
                yield frame({id_col: part[id_col], "held_out": part["held_out"], "n_tokens": lengths,
                             "frequent": np.add.reduceat((ids >= 0).astype(np.int64), starts),
                             "log_count": np.add.reduceat(vocabulary.logs[ids], starts),
                             "log_class": np.add.reduceat(logs, starts), "rare": rare})

    rated = rows.mapInPandas(rate, f"`{id_col}` {kind}, held_out boolean, n_tokens long, frequent long, log_count double, "
                                   "log_class double, rare array<string>")
    rated = durable(rated.withColumn("_row", F.monotonically_increasing_id()), "rated")
    tail = rated.select("_row", F.explode("rare").alias("word")).join(counts, "word", "left").groupBy("_row").agg(
        F.count("n").alias("found"), F.sum(F.log10(F.coalesce(F.col("n"), F.lit(0)) + SMOOTH)).alias("tail_log"))
    rated = rated.drop("rare").join(tail, "_row", "left")
    log_count = F.col("log_count") + F.coalesce("tail_log", F.lit(0.0))
    return rated.select(
        id_col, "held_out", "n_tokens", (F.col("frequent") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (log_count - F.col("n_tokens") * math.log10(n + SMOOTH * (v + 1))).alias("base_score"),
        (log_count + F.col("log_class")).alias("score"))
