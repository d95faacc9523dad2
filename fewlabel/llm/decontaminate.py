"""Benchmark passages in documents: pigeonhole pieces, then bit-parallel edit distance.

An item that occurs with at most ``e`` edits contains one of its ``e + 1`` pieces unchanged. The pieces of a block
of items are looked up in one pass over every text, and the places they point at are verified.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fewlabel.llm.common import frame, text_of
from fewlabel.session import durable

WORD = re.compile(r"\w+")
ERROR_RATE = 0.08
LEAST_CHARS = 40  # shorter items are matched without errors, as whole words


def plain(text: str) -> str:
    """Lower-case words joined by one blank: what counts when texts are compared."""
    return " ".join(WORD.findall(text.lower()))


def budget(length: int, rate: float = ERROR_RATE) -> int:
    """The edits an item of so many characters may differ by."""
    return int(length * rate) if length >= LEAST_CHARS else 0


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` even pieces with their offsets."""
    edges = [i * len(item) // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:]) if b > a]


def masks(pattern: str) -> dict[str, int]:
    table: dict[str, int] = {}
    for i, c in enumerate(pattern):
        table[c] = table.get(c, 0) | 1 << i
    return table


def best_end(pattern_masks: dict[str, int], length: int, text: str, most: int) -> tuple[int, int]:
    """The least edit distance between the pattern and any part of ``text``, and the first end that has it.

    Myers' bit vectors: one Python integer holds a column's vertical differences, so a character costs a few integer
    operations whatever the pattern's length. ``(most + 1, -1)`` if nothing is within ``most``.
    """
    full, high = (1 << length) - 1, 1 << (length - 1)
    plus, minus, score = full, 0, length
    best, end = (length, 0) if length <= most else (most + 1, -1)
    for at, c in enumerate(text, 1):
        eq = pattern_masks.get(c, 0)
        xv = eq | minus
        xh = ((((eq & plus) + plus) ^ plus) | eq) & full
        ph = minus | (full & ~(xh | plus))
        mh = plus & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        if score < best:
            best, end = score, at
            if score == 0:
                break
        ph, mh = (ph << 1) & full, (mh << 1) & full
        plus = mh | (full & ~(xv | ph))
        minus = ph & xv
    return best, end


class Matcher:
    """Looks for a bounded block of items in one text after the other."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items, self.automaton = {}, ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for key, text in items:
            item = plain(text)
            if not item:
                continue
            errors = budget(len(item), rate)
            self.items[key] = (item, errors, masks(item), masks(item[::-1]))
            for at, piece in pieces(item, errors):
                places.setdefault(piece, []).append((key, at))
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """``(item, distance, start, end)`` in the plain text, one best place per item."""
        if not self.items:
            return []
        text = plain(text)
        starts: dict[int, list[int]] = {}
        for last, (size, where) in self.automaton.iter(text):
            for key, at in where:
                starts.setdefault(key, []).append(last - size + 1 - at)
        found = []
        for key, ats in starts.items():
            item, errors, forward, backward = self.items[key]
            best = (errors + 1, -1)
            ats.sort()
            if errors == 0:  # the only piece is the item itself
                whole = [at for at in ats if self._whole(text, at, at + len(item), len(item))]
                found += [(key, 0, at, at + len(item)) for at in whole[:1]]
                continue
            low = high = ats[0]
            for at in [*ats[1:], None]:
                if at is not None and at - high <= errors:
                    high = at
                    continue
                left, right = max(0, low - errors), high + len(item) + errors
                # A verbatim hit needs no distance.
                exact = text.find(item, left, right)
                got = (0, exact + len(item)) if exact >= 0 else None
                if got is None:
                    d, end = best_end(forward, len(item), text[left:right], errors)
                    got = (d, left + end)
                if got and got[0] < best[0]:
                    best = got
                low = high = at
            if best[0] <= errors:
                end = best[1]
                back = text[max(0, end - len(item) - errors):end][::-1]
                _, size = best_end(backward, len(item), back, errors)
                found.append((key, best[0], end - size, end))
        return sorted(found)

    @staticmethod
    def _whole(text: str, start: int, end: int, size: int) -> bool:
        """Short items must stand as words of their own."""
        return size >= LEAST_CHARS or text[max(0, start - 1):start].strip() == "" and text[end:end + 1].strip() == ""


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", rate: float = ERROR_RATE,
                  block: int = 5_000) -> DataFrame:
    """``id_col, item_id, distance, start, end``: every (row, item) where the item occurs in the whole text with at most
    ``budget(length)`` edits; its closest place (the first of equals), as offsets in ``plain(text)``.

    Items are a stated query set: blocks of up to ``block`` of them, dealt by a hash of their id, go to the tasks that
    scan the documents, one scan per block, so what a task and the driver hold is bounded by ``block`` items whatever
    the benchmark's size. Documents are never shuffled. Null and empty texts or items match nothing, nor do items
    without a word; null ids are kept as they are for documents and left out for items; repeated rows are answered once
    each, repeated items once. Other columns are left out.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), text_of(text_col).alias("text"))
    items = benchmark.where(F.col(item_col).isNotNull() & (F.length(item_text_col) > 0)).groupBy(
        F.col(item_col).cast("long").alias("item_id")).agg(F.min(item_text_col).alias("text"))
    items = durable(items, "items")
    blocks = max(1, -(-items.count() // (block // 2)))
    shape = f"`{id_col}` {kind}, item_id long, distance int, start int, end int"
    found = None
    for number in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number).collect()
        part = rows.mapInPandas(_search([(r["item_id"], r["text"]) for r in own], rate, id_col), shape)
        found = part if found is None else found.unionByName(part)
    return found


def _search(items: list[tuple[int, str]], rate: float, id_col: str):
    def run(batches):
        matcher = Matcher(items, rate)
        for batch in batches:
            out = [(i, *hit) for i, t in zip(batch[id_col], batch["text"]) for hit in matcher.find(t)]
            names = [id_col, "item_id", "distance", "start", "end"]
            yield frame({name: [row[i] for row in out] for i, name in enumerate(names)})
    return run


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          rate: float = ERROR_RATE) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, all columns as they are. Rows with a null id are told
    apart by their text, so only those that contain an item go."""
    named = docs.where(F.col(id_col).isNotNull())
    found = contamination(named, benchmark, id_col, text_col, rate=rate).select(id_col).distinct()
    unnamed = docs.where(F.col(id_col).isNull())
    texts = unnamed.select(F.col(text_col).alias("_text"), F.col(text_col).alias("text")).distinct()
    bad = contamination(texts, benchmark, "_text", "text", rate=rate).select("_text").distinct()
    rest = unnamed.join(bad, unnamed[text_col] == bad["_text"], "left_anti")
    return named.join(found, id_col, "left_anti").unionByName(rest)
