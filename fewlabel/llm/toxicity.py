"""Toxicity: a noisy-channel reading of disguised words, then a linear score over the restored text.

A disguised word is a lattice: every character may stand for itself, for letters it looks like, or for nothing (a
separator, a repeated letter). A character model of the corpus picks the likeliest path by Viterbi. Words and word
beginnings of the restored text are the features of a logistic regression.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fewlabel.llm.common import frame, held_out, text_of
from fewlabel.session import durable

# What a character may stand for, besides itself if it is a letter.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a",
         "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
SEPARATORS = frozenset(".-_*~'`^,/\\ ")
EDGES = ".,;:?!\"'()[]{}<>|/\\-_*~#%&=+ "
LONGEST = 40  # characters decoded at a time; longer strings are read in parts that overlap by half
SYMBOLS = 28  # word edge, a to z, any other letter
EDGE = "[" + re.escape(EDGES.strip()) + "]"
UNIT = rf"(?:{EDGE}*[^\s{EDGE[1:-1]}]{EDGE}*|{EDGE})"  # one character, maybe with punctuation around
SPACED = re.compile(rf"(?<!\S){UNIT}(?:\s+{UNIT}){{2,}}(?!\S)")
PLAIN = re.compile(r"[^\W\d_]+")
REPEAT = re.compile(r"(.)\1\1")
REPEATS = re.compile(r"(.)\1{2,}", re.S)
STARTS = (4, 5, 6)
BROADCAST_ROWS = 1_000_000
FIT_ROWS = 20_000
LEAST_ODDS = 2.5  # bound on a feature's log odds; four labelled texts and none without reach it
WORDS_KEPT = 100_000  # words whose features a task remembers; with more it forgets them
FEATURES_KEPT = 150_000  # features a task counts before it hands the counts on


def _symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27


def trigram_counts(texts) -> np.ndarray:
    """Counts of letter triples, flat; everything that is no letter is a word edge."""
    total = np.zeros(SYMBOLS ** 3, dtype=np.int64)
    for text in texts:
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        small = np.where(codes < 128, codes, 0)
        kinds = np.where((codes >= 97) & (codes <= 122), codes - 96, np.where((codes >= 0xC0) & (codes != 0xD7) & (codes != 0xF7), 27, 0))
        kinds = np.concatenate([[0, 0], np.where(small == codes, kinds, kinds), [0]]).astype(np.int64)
        total += np.bincount((kinds[:-2] * SYMBOLS + kinds[1:-1]) * SYMBOLS + kinds[2:], minlength=SYMBOLS ** 3)
    return total


def log_trigrams(counts: np.ndarray) -> list[float]:
    """Natural logarithms of P(third | first two), backed by the letters' own shares."""
    cube = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
    share = (cube.sum(axis=(0, 1)) + 1) / (cube.sum() + SYMBOLS)
    return np.log((cube + 5 * share) / (cube.sum(axis=2, keepdims=True) + 5)).ravel().tolist()


def decode(word: str, model: list[float], edges: bool = False) -> str:
    """The likeliest reading of a disguised word: Viterbi over its lattice, the state being the last two letters.

    Reading a character as another one costs a little, leaving out a repeated letter or a separator nothing, so the
    longest runs shrink to what words look like. Equal scores go to the first reading in the order of the alphabet. With
    ``edges`` a word may end and the next one start after any letter; a blank in the reading stands for it.
    """
    states = {(0, 0): (0.0, "")}
    before = ""
    for c in word:
        choices = [(c, 0.0)] if c.isalpha() else []
        choices += [(x, -0.5) for x in LOOKS.get(c, "")]
        skip = c in SEPARATORS or c == before
        following: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, text) in states.items():
            options = [((b, _symbol(x)), score + cost + model[(a * SYMBOLS + b) * SYMBOLS + _symbol(x)], text + x)
                       for x, cost in choices]
            if skip or not choices:
                options.append(((a, b), score, text))
            if edges:
                options += [((y, 0), value + model[(x * SYMBOLS + y) * SYMBOLS], reading + " ")
                            for (x, y), value, reading in options if y]
            for key, value, reading in options:
                old = following.get(key)
                if old is None or (value, old[1]) > (old[0], reading):
                    following[key] = (value, reading)
        states, before = following, c
    ends = ((score + (0.0 if edges and text and not b else model[(a * SYMBOLS + b) * SYMBOLS]), text) for (a, b), (score, text) in states.items())
    return max(ends, key=lambda e: (e[0], tuple(-ord(x) for x in e[1])))[1]


def _decoded(core: str, model: list[float]) -> list[str]:
    """The decoded form of a string; a long one is shortened where a character repeats, then read as words part by part."""
    if len(core) > LONGEST:
        core = REPEATS.sub(r"\1\1", core)
    if len(core) <= LONGEST:
        return [decode(core, model)]
    return words_of(core, model)


def words_of(letters: str, model: list[float]) -> list[str]:
    """The likeliest words of a string without blanks. Parts of ``LONGEST`` characters overlap by half."""
    if len(letters) > LONGEST:
        letters = REPEATS.sub(r"\1\1", letters)
    step = LONGEST // 2
    parts = [letters[at:at + LONGEST] for at in range(0, max(1, len(letters) - step), step)]
    return list(dict.fromkeys(w for part in parts for w in decode(part, model, edges=True).split()))


def readings(token: str, model: list[float]) -> list[str]:
    """The words a lower-case token may be: its letters as they stand, and the decoded form of a disguised one."""
    core = token.strip(EDGES)
    if PLAIN.fullmatch(core):
        out = [core]
        if REPEAT.search(core):
            out += _decoded(core, model)
        elif core != token and token[0] in LOOKS and not token[0].isalnum() and token[1:2].isalpha():
            out += _decoded(token[0] + core, model)
        return out
    bare = core.rstrip("$@€£0123456789").strip(EDGES)
    out = [bare] if PLAIN.fullmatch(bare) else PLAIN.findall(core)
    if any(c.isalpha() for c in core):
        out += _decoded(core, model)
    return out


def spaced_words(stretch: str, model: list[float]) -> list[str]:
    """The words that letters with blanks between may be: all of them as one, those between wider blanks, and the likeliest words."""
    gaps = [len(g) for g in re.findall(r"\s+", stretch)]
    wide = re.split(r"\s{%d,}" % (min(gaps) + 1), stretch)
    out: dict[str, None] = {}
    for part in (wide if len(wide) == 1 else [stretch, *wide]):
        letters = "".join(t.strip(EDGES) or t for t in part.split())
        if any(c.isalpha() for c in letters):
            out.update(dict.fromkeys(readings(letters, model) + words_of(letters, model)))
    return list(out)


def features(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word, *(f"{word[:n]}~" for n in STARTS if len(word) > n)]


class Reader:
    """Distinct features of texts, with the work on a word remembered for a bounded number of words."""

    def __init__(self, model: list[float], wanted: dict[str, int] | None = None):
        self.model, self.wanted, self.known = model, wanted, {}

    def _word(self, token: str, read=readings) -> tuple:
        got = self.known.get(token)
        if got is None:
            if len(self.known) >= WORDS_KEPT:
                self.known.clear()
            names = [f for r in read(token, self.model) for f in features(r)]
            got = tuple(names) if self.wanted is None else tuple(self.wanted[f] for f in names if f in self.wanted)
            self.known[token] = got
        return got

    def read(self, text: str) -> set:
        text = text.lower()
        tokens = set(text.split())
        found = set()
        for token in tokens:
            found.update(self._word(token))
        for m in SPACED.finditer(text):
            found.update(self._word(m.group(), spaced_words))
        return found


def character_model(docs: DataFrame, text_col: str = "text") -> list[float]:
    """Letter triples of all texts, counted in the tasks; at most ``SYMBOLS ** 3`` sums reach the driver."""
    def count(batches):
        total = np.zeros(SYMBOLS ** 3, dtype=np.int64)
        for batch in batches:
            total += trigram_counts(batch["text"])
        at = np.flatnonzero(total)
        yield frame({"triple": at, "n": total[at]})

    rows = docs.select(text_of(text_col).alias("text")).mapInPandas(count, "triple long, n long")
    counts = np.zeros(SYMBOLS ** 3, dtype=np.int64)
    for r in rows.groupBy("triple").agg(F.sum("n").alias("n")).collect():
        counts[r["triple"]] = r["n"]
    return log_trigrams(counts)


def _fit(rows: list[tuple[list[int], int]], size: int, rounds: int = 300, penalty: float = 0.01) -> tuple[np.ndarray, float]:
    """Logistic regression over binary features by full gradients with a running scale per weight."""
    at = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    col = np.fromiter((i for f, _ in rows for i in f), dtype=np.int64, count=len(at))
    y = np.array([label for _, label in rows], dtype=float)
    w, b = np.zeros(size), math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(at, weights=w[col], minlength=len(y)) + b, -30, 30)))
        e = p - y
        g = np.append(np.bincount(col, weights=e[at], minlength=size) + penalty * w, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, b


class Model:
    """What scoring needs: the character model, the features and their weights. It grows with the features that pass
    the bound, which at least four labelled texts must have."""

    def __init__(self, letters: list[float], names: dict[str, int], weights: np.ndarray, bias: float):
        self.letters, self.names, self.weights, self.bias = letters, names, weights, bias


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          parts: int = 5, corpus: DataFrame | None = None) -> Model:
    """Learns from the labelled rows that are not held out.

    Feature counts cover all of these rows; every feature whose odds pass the bound is kept. The regression is fitted on
    about ``FIT_ROWS`` rows at most, those with the smallest hashes of their id; features that none of them has
    weigh their bound, times what the fitted weights are of theirs. Labels other than 0 and 1 are left out;
    of repeated labels of an id the largest counts. Without labelled rows of both kinds every score is the share of the
    label, which is one third (not toxic) where there are none.
    """
    letters = character_model(docs if corpus is None else corpus, text_col)
    marks = labels.where(F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    marks = durable(marks, "marks")
    texts = docs.where(~held_out(id_col, parts)).select(id_col, text_of(text_col).alias("text"))
    if marks.count() <= BROADCAST_ROWS:  # two numbers a row; the texts stay where they are
        known = texts.join(F.broadcast(marks), id_col)
    else:  # the texts are shuffled once and kept, since they are read three times
        known = durable(texts.join(marks, id_col), "labelled")

    def names(batches):
        reader, total = Reader(letters), {}
        for batch in batches:
            for text, y in zip(batch["text"], batch["y"]):
                for f in reader.read(text):
                    pair = total.setdefault(f, [0, 0])
                    pair[y] += 1
                if len(total) > FEATURES_KEPT:
                    yield _counted(total)
                    total = {}
        yield _counted(total)

    sides = known.groupBy("y").count().collect()
    size = {r["y"]: r["count"] for r in sides}
    zeros, ones = size.get(0, 0), size.get(1, 0)
    if not zeros or not ones:
        return Model(letters, {}, np.zeros(0), math.log((ones + 0.5) / (zeros + 1)))
    counts = known.select("text", "y").mapInPandas(names, "feature string, zero long, one long")
    counts = counts.groupBy("feature").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one"))
    # A lower bound of how much likelier the label is with the feature than without, weighed by how often it says so.
    odds = F.log((F.col("one") + 0.5) / (ones + 1)) - F.log((F.col("zero") + 0.5) / (zeros + 1))
    bound = odds - F.sqrt(1 / (F.col("one") + 0.5) + 1 / (F.col("zero") + 0.5))
    clear = sorted(counts.where(bound > LEAST_ODDS).select("feature", bound.alias("bound")).collect())
    wanted, bounds = {r["feature"]: i for i, r in enumerate(clear)}, np.array([r["bound"] for r in clear], dtype=float)

    def lists(batches):
        reader = Reader(letters, wanted)
        for batch in batches:
            yield frame({"y": batch["y"], "f": [sorted(reader.read(t)) for t in batch["text"]]})

    share = int(2 ** 31 * min(1.0, FIT_ROWS / (zeros + ones)))
    sample = known.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(2 ** 31)) < share).select("text", "y")
    rows = [(list(r["f"]), r["y"]) for r in sample.mapInPandas(lists, "y int, f array<int>").collect()]
    weights, bias = _fit(rows, len(wanted))
    return Model(letters, wanted, _with_unseen(weights, bounds, rows), bias)


def _with_unseen(weights: np.ndarray, bounds: np.ndarray, rows: list[tuple[list[int], int]]) -> np.ndarray:
    """The weights, those of features in none of ``rows`` from their bounds."""
    seen = np.zeros(len(weights), dtype=bool)
    seen[[i for f, _ in rows for i in f]] = True
    scale = weights[seen] @ bounds[seen] / (bounds[seen] @ bounds[seen]) if seen.any() else 1.0
    return np.where(seen, weights, scale * bounds)


def _counted(total: dict[str, list[int]]) -> pd.DataFrame:
    return frame({"feature": list(total), "zero": [v[0] for v in total.values()], "one": [v[1] for v in total.values()]})


def rating(model: Model, text_col: str = "text") -> Column:
    """The probability (0 to 1) of the label from the whole text alone, as a column to select or filter by.

    A null text counts as the empty one, whose score is that of a text without any feature.
    """
    @F.pandas_udf("double")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(model.letters, model.names)
        for texts in batches:
            out = [model.bias + sum(model.weights[i] for i in sorted(reader.read(t or ""))) for t in texts]
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(out, dtype=float), -30, 30))))

    return rate(text_of(text_col))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below one half, with all columns as they are; repeated rows are rated alike."""
    return docs.where(rating(train(docs, labels, id_col, text_col), text_col) < 0.5)
