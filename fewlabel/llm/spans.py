"""Repeated passages across documents: hash runs of consecutive sentences and stretches of words, join the hashes, remove
the sentences of later occurrences."""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fewlabel.llm.common import frame, text_of
from fewlabel.session import durable

# White space after a stop or with a line feed, as a whole; that every match begins with white space lets the search skip the rest.
BREAK = re.compile(r"\s(?:(?<=[.!?]\s)\s*|(?<=\n)\s*|[^\S\n]*\n\s*)")
RUN_WORDS, PASSAGE_WORDS = 25, 50
KEPT_WORDS = 200_000
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_KNOWN: dict[int, np.ndarray] = {}


def sentences(text: str) -> list[tuple[int, int, int]]:
    """``(start, end, next)``: a sentence ends at a stop before white space or at a line's end; ``next`` is where the
    following one starts. Pieces without a word are left out."""
    breaks = [m.span() for m in BREAK.finditer(text)]
    out = list(zip([0, *(b for _, b in breaks)], [*(a for a, _ in breaks), len(text)], [*(b for _, b in breaks), len(text)]))
    if out and not text[out[-1][0]:].strip():
        out.pop()
    return out[1:] if out and not text[:out[0][1]].strip() else out


def sentence_words(text: str) -> list[list[str]]:
    """The words of every sentence in lower case. Between two breaks there is always a word."""
    lines = [line.split() for line in BREAK.sub("\n", text).lower().split("\n")]
    return [words for words in lines if words]


class _Codes(dict):
    """A word's 64-bit hash as eight bytes; up to ``KEPT_WORDS`` words are kept, so that a frequent one is hashed once."""

    def __missing__(self, word: str) -> bytes:
        code = xxhash.xxh3_64_digest(word.encode("utf-8", "surrogatepass"))
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = code
        return code


_CODES = _Codes()


def word_codes(said: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of the sentences, and the number of the first word of every sentence, then of all."""
    raw = b"".join(map(_CODES.__getitem__, chain.from_iterable(said)))
    return np.frombuffer(raw, dtype=">u8").astype(np.uint64), np.cumsum([0, *map(len, said)])


def runs(codes: np.ndarray, starts: np.ndarray, least: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Runs ``(first, last + 1)`` of consecutive sentences, given as by ``word_codes``, with their 64-bit hashes.

    From every sentence the shortest run forward and the shortest run backward that have ``least`` words, so any
    repeated passage of whole sentences with so many words is covered from its first to its last sentence. A sentence
    of ``least`` words is a run of its own. Letter case and the amount of white space do not count.
    """
    n = len(starts) - 1
    first = np.arange(n)
    last = np.searchsorted(starts, starts[:-1] + least)
    ends = np.searchsorted(starts, starts[1:] - least, "right") - 1
    a, b = np.divmod(np.unique(np.concatenate([(first * (n + 1) + last)[last <= n], (ends * (n + 1) + first + 1)[ends >= 0]])), n + 1)
    # A zero stands after every sentence.
    raw, place = np.insert(codes, starts[1:], 0).tobytes(), 8 * (starts + np.arange(n + 1))
    whole = xxhash.xxh3_64_intdigest
    hashes = np.array([whole(raw[x:y]) for x, y in zip(place[a].tolist(), place[b].tolist())], dtype=np.uint64)
    return list(zip(a.tolist(), b.tolist())), hashes.view(np.int64)


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` from one up; those for texts of up to 2 ** 16 words are kept."""
    if n > 1 << 16:
        return np.cumprod(np.full(n, base, dtype=np.uint64))
    if base not in _KNOWN:
        _KNOWN[base] = np.cumprod(np.full(1 << 16, base, dtype=np.uint64))
    return _KNOWN[base][:n]


def stretches(codes: np.ndarray, width: int) -> np.ndarray:
    """The hash of ``width`` words from every word on: a polynomial in the words' hashes modulo 2 ** 64, mixed."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    up, down = _powers(BASE, len(codes)), _powers(INVERSE, n)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(codes * up, dtype=np.uint64)])
    mixed = (sums[width:] - sums[:-width]) * down
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(31))


def anchors(codes: np.ndarray, run_words: int, passage_words: int) -> np.ndarray:
    """The anchor of every stretch of ``passage_words`` words: the smallest hash of ``run_words`` words in it. Equal stretches
    have equal anchors, and neighbours mostly share one, so a text has about one anchor for ``run_words / 2`` words."""
    width = max(1, min(run_words, passage_words))
    grams = stretches(codes, width)
    around = passage_words - width + 1
    if len(grams) < around:
        return np.empty(0, dtype=np.int64)
    # The smallest of ever wider windows, then of two that overlap.
    least, wide = grams, 1
    while 2 * wide <= around:
        least, wide = np.minimum(least[:-wide], least[wide:]), 2 * wide
    if wide < around:
        least = np.minimum(least[:wide - around], least[around - wide:])
    return least.view(np.int64)


def _whole(at: np.ndarray, starts: np.ndarray, words: int) -> np.ndarray:
    """The sentences all of whose words lie in one of the stretches of ``words`` words that begin at ``at``."""
    marks = np.zeros(starts[-1] + 1, dtype=np.int64)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + words, -1)
    bare = np.concatenate([[0], np.cumsum(np.cumsum(marks[:-1]) == 0)])
    return bare[starts[1:]] == bare[starts[:-1]]


def _by_runs(n: int, spans: list[tuple[int, int]], hashes: np.ndarray, bad: set[int]) -> np.ndarray:
    """Which of ``n`` sentences a run covers whose hash is in ``bad`` or came before in the text."""
    marks, seen = np.zeros(n + 1, dtype=np.int64), set()
    for (first, last), h in sorted(zip(spans, hashes.tolist())):
        if h in bad or h in seen:
            marks[first] += 1
            marks[last] -= 1
        seen.add(h)
    return np.cumsum(marks[:-1]) > 0


def again(own: np.ndarray) -> np.ndarray:
    """Which of a text's stretches came before in it."""
    late = np.zeros(len(own), dtype=bool)
    if len(set(own.tolist())) < len(own):
        late[:] = True
        late[np.unique(own, return_index=True)[1]] = False
    return late


def undecided(text: str, bad, run_words: int = RUN_WORDS, passage_words: int = PASSAGE_WORDS) -> np.ndarray:
    """The anchors in ``bad`` whose stretches of words may cover a whole sentence that repeated runs do not remove."""
    said = sentence_words(text)
    codes, starts = word_codes(said)
    own = anchors(codes, run_words, passage_words)
    at = np.flatnonzero(np.isin(own, np.fromiter(bad, dtype=np.int64, count=len(bad))))
    if not len(at):
        return own[:0]
    open_ = _whole(at, starts, passage_words)
    if not open_.any():
        return own[:0]
    open_ &= ~_by_runs(len(said), *runs(codes, starts, run_words), set(bad))
    before = np.concatenate([[0], np.cumsum(np.repeat(open_, np.diff(starts)))])
    return np.unique(own[at[before[at + passage_words] > before[at]]])


def removed(text: str, bad, run_words: int = RUN_WORDS, passage_words: int = PASSAGE_WORDS, words_bad=()) -> tuple[int, list[tuple[int, int]]]:
    """The number of sentences, and the parts ``(start, end)`` of ``text`` to remove.

    Every sentence goes that a run covers whose hash is in ``bad`` or came before in this text. So does every sentence that
    lies whole in stretches of ``passage_words`` words whose hash is in ``words_bad`` or came before in this text, wherever
    in a sentence these begin and end.
    """
    pieces, said = sentences(text), sentence_words(text)
    codes, starts = word_codes(said)
    gone = _by_runs(len(said), *runs(codes, starts, run_words), set(bad))
    own = stretches(codes, passage_words)
    late = again(own)
    if len(words_bad):
        late |= np.isin(own.view(np.int64), np.asarray(words_bad, dtype=np.int64))
    if late.any():
        gone |= _whole(np.flatnonzero(late), starts, passage_words)
    out, i = [], 0
    while i < len(pieces):
        j = i
        while j < len(pieces) and gone[j]:
            j += 1
        if j > i:
            out.append((pieces[i][0], pieces[j - 1][2]))
        i = max(j, i + 1)
    return len(pieces), out


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS,
                 passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """``id_col, text_col, sentences, removed``: the text without its repeated passages, the number of its sentences and
    the removed parts as ``array<struct<start, end>>`` in code points of the whole text.

    A run is repeated if a document with a smaller id, or an earlier place of the same text, has it; rows that share an id
    count as one document. Null texts are empty ones; rows with a null id take no part and stay as they are, as do
    repeated rows. Other columns are left out.

    All sentences that a repeated run covers go, and those that lie whole in a later occurrence of ``passage_words`` words or more
    whose edges are inside of sentences. Words are compared without letter case and white space.

    Every text hands out each of its run hashes and anchors once. They are counted per hash with partial sums in the tasks, so
    a passage that a third of all documents share meets as one row per task; the repeated hashes are joined back, and only the
    hashes that are not first for a document travel to its text. Where runs leave a sentence that repeated anchors may
    cover, all texts with such an anchor hand out the hashes of its stretches of ``passage_words`` words, which are
    counted in the same way. A hash has 64 bits: about one false match is expected in 6e9 runs.
    """
    rows = docs.select(F.col(id_col), text_of(text_col).alias(text_col))
    kind = rows.schema[id_col].dataType.simpleString()

    def hand_out(batches):
        for batch in batches:
            out, inner = [], []
            for text in batch[text_col]:
                codes, starts = word_codes(sentence_words(text))
                _, hashes = runs(codes, starts, run_words)
                own = np.unique(hashes)
                inner.append(len(own) < len(hashes) or again(stretches(codes, passage_words)).any())
                out.append(np.unique(np.concatenate([own, anchors(codes, run_words, passage_words)])))
            yield frame({id_col: batch[id_col], "inner": np.array(inner, dtype=bool), "h": out})

    def ask(batches):
        for batch in batches:
            found = [undecided(text, bad.tolist(), run_words, passage_words) for text, bad in zip(batch[text_col], batch["_bad"])]
            yield frame({"h": np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.int64)})

    def answer(batches):
        for batch in batches:
            out = []
            for text, asked in zip(batch[text_col], batch["_asked"]):
                codes, _ = word_codes(sentence_words(text))
                at = np.isin(anchors(codes, run_words, passage_words), asked)
                out.append(np.unique(stretches(codes, passage_words).view(np.int64)[at]))
            yield frame({id_col: batch[id_col], "h": out})

    def not_first(handed, name):
        first = handed.groupBy("h").agg(F.min(id_col).alias("_first"), F.max(id_col).alias("_last")).where("_first < _last").select("h", "_first")
        return handed.join(durable(first, name), "h").where(F.col(id_col) > F.col("_first"))

    given = rows.where(F.col(id_col).isNotNull()).mapInPandas(hand_out, f"`{id_col}` {kind}, inner boolean, h array<bigint>")
    given = durable(given, "runs")
    inner = given.where("inner").select(id_col).distinct().withColumn("_inner", F.lit(True))
    given = given.select(F.col(id_col), F.explode("h").alias("h"))
    later = durable(not_first(given, "repeated_runs").groupBy(id_col).agg(F.collect_set("h").alias("_bad")), "later_runs")
    asked = durable(rows.join(later, id_col).mapInPandas(ask, "h bigint").distinct(), "asked")
    wanted = durable(given.join(asked, "h").groupBy(id_col).agg(F.collect_set("h").alias("_asked")), "wanted")
    answers = rows.join(wanted, id_col).mapInPandas(answer, f"`{id_col}` {kind}, h array<bigint>")
    answers = durable(answers.select(F.col(id_col), F.explode("h").alias("h")), "stretches")
    words = durable(not_first(answers, "repeated_stretches").groupBy(id_col).agg(F.collect_set("h").alias("_words")), "later_stretches")
    # A text that shares nothing and repeats nothing is not looked at again.
    joined = rows.join(later.join(words, id_col, "full").join(inner, id_col, "full"), id_col, "left")

    def cut(batches):
        for batch in batches:
            texts, counts, parts = [], [], []
            for text, bad, far, inner in zip(batch[text_col], batch["_bad"], batch["_words"], batch["_inner"]):
                if bad is None and far is None and inner is not True:
                    n, gone = sum(1 for part in BREAK.split(text) if part and not part.isspace()), []
                else:
                    n, gone = removed(text, () if bad is None else bad.tolist(), run_words, passage_words, () if far is None else far)
                edges = [0, *(x for part in gone for x in part), len(text)]
                texts.append("".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                counts.append(n)
                parts.append([{"start": a, "end": b} for a, b in gone])
            yield frame({id_col: batch[id_col], text_col: texts, "sentences": counts, "removed": parts})

    return joined.mapInPandas(cut, f"`{id_col}` {kind}, `{text_col}` string, sentences int, removed array<struct<start:int,end:int>>")
