"""SentencePiece encoding and decoding with forward states shared along common word prefixes."""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fewlabel.llm.common import frame, text_of

MARK = "▁"
KNOWN_WORDS = 300_000  # with more encoded words than this a task forgets them before it reads on
FITS_KEPT = 2_000_000  # pairs of pieces remembered at a time
SLICE = 4_000_000  # characters whose words are encoded in one walk


class Pieces:
    """A vocabulary read from a SentencePiece model file, with its encoder.

    Words are encoded by a forward pass over their characters. For the word's prefix of each length the pass keeps the
    one piece that may end there, so a prefix is worked out once for all words that share it: distinct words are sorted,
    which walks their trie depth first, and a word starts from the states of the prefix it has in common with the one before.

    For merge vocabularies (BPE) a piece may end a prefix when merging the text of the piece before and its own gives
    these two pieces again; exactly one piece does, and the walk back from the last state gives the same pieces as merging
    pairs by rank. For unigram vocabularies (``merges=False``) it is the piece with the best sum of scores (the later start, if equal).
    """

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: dict[int, int], unknown: int, merges: bool = True,
                 special: frozenset[int] = frozenset()):
        raw = special | set(byte_ids.values())
        self.ids = {p: i for i, p in enumerate(pieces) if i not in raw}
        self.names, self.scores, self.bytes, self.unknown, self.merges = pieces, scores, byte_ids, unknown, merges
        self.special, self.from_byte = special, {i: b for b, i in byte_ids.items()}
        self.longest = max(map(len, self.ids), default=1)
        self.rank = {p: -scores[i] for p, i in self.ids.items()}
        # Every ending of a piece with what is known of the pieces that may stand before it, or None where it is no piece itself.
        self.endings: dict[str, dict[str, bool] | None] = {p[k:]: None for p in self.ids for k in range(len(p))}
        self.endings.update({p: {} for p in self.ids})
        self.packed = {p: np.int32(i).tobytes() for p, i in self.ids.items()}
        # Where two characters never stand together in a piece, no piece can reach over them.
        self.pairs = {p[k:k + 2] for p in self.ids for k in range(len(p) - 1)}
        breaks = "".join(c for c in "\n\t\r" if c not in self.endings)
        inner = f"[^{MARK}{re.escape(breaks)}]" if breaks else f"[^{MARK}]"
        self.unit = re.compile(f"{MARK}*{inner}+|{MARK}+" + (f"|[{re.escape(breaks)}]+" if breaks else ""))
        self.shown = [n.replace(MARK, " ") for n in pieces]
        for i in special:
            self.shown[i] = ""
        for i, value in self.from_byte.items():
            self.shown[i] = chr(value) if value < 128 else ""
        self.high = np.array([self.from_byte.get(i, 0) > 127 for i in range(len(pieces))] or [False])
        self.fits_known = 0
        self.worst = min(scores, default=0.0) - 10.0
        self.lines = "\n" not in self.endings
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}

        # How runs of blanks are cut. Where a run of three lengths of the longest piece starts with that piece and goes on
        # like the run without it, all longer ones do.
        most = max((k for k in range(1, self.longest + 1) if MARK * k in self.ids), default=1)
        self.runs = [self.merged(MARK * k) for k in range(3 * most + 1)]
        self.period = most if all(self.runs[k] == [MARK * most, *self.runs[k - most]] for k in range(2 * most, 3 * most + 1)) else 0

    @classmethod
    def load(cls, model: bytes, merges: bool = True) -> Pieces:
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        return cls(names, [sp.get_score(i) for i in range(n)], {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)},
                   sp.unk_id(), merges, frozenset(i for i in range(n) if sp.is_control(i) or sp.is_unknown(i)))

    def merged(self, text: str) -> list[str]:
        """Merge the adjacent pair with the best score, the first of equals, until no pair is a piece."""
        parts, rank = list(text), self.rank.get
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = rank(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, before: str, piece: str) -> bool:
        if self.fits_known >= FITS_KEPT:
            for known in self.endings.values():
                if known:
                    known.clear()
            self.fits_known = 0
        self.fits_known += 1
        got = self.endings[piece][before] = self.merged(before + piece) == [p for p in (before, piece) if p]
        return got

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of every distinct word as 32-bit numbers, in one depth-first walk over the sorted words."""
        out: dict[str, bytes] = {}
        step = self._extend_merges if self.merges else self._extend_sums
        blanks: list[str] = []
        packed, last = self.packed, ""
        # After i characters: the piece that ends there, and for unigrams its score.
        pieces, sums = [""], [0.0]
        for word in sorted(words):
            if self.merges and word[1:2] == MARK:
                blanks.append(word)
                continue
            shared = 0
            for a, b in zip(word, last):
                if a != b:
                    break
                shared += 1
            del pieces[shared + 1:], sums[shared + 1:]
            step(word, shared, pieces, sums)
            end = len(word)
            last = word[:len(pieces) - 1]
            if len(last) != end:  # scores that tie can leave a prefix open: merge this word as it stands
                out[word] = self._pack(self.merged(word))
                continue
            found = []
            while end:
                piece = pieces[end]
                found.append(piece)
                end -= len(piece)
            found.reverse()
            try:
                out[word] = b"".join([packed[p] for p in found])
            except KeyError:
                out[word] = self._pack(found)
        if blanks:
            self._blank_runs(blanks, out)
        return out

    def _extend_merges(self, word: str, shared: int, pieces: list[str], sums: list[float]) -> None:
        """The piece that ends each prefix of ``word`` beyond ``shared`` characters, as far as there is one."""
        endings, append = self.endings, pieces.append
        for end in range(shared + 1, len(word) + 1):
            for start in range(end - 1, -1, -1):
                piece = word[start:end]
                known = endings.get(piece, False)
                if known is None:
                    continue
                if known is False:  # no piece ends like this, so none starts further left
                    if start == end - 1:  # not in the vocabulary: stands alone, later spelled in bytes
                        append(piece)
                        break
                    return
                before = pieces[start]
                fit = known.get(before)
                if fit is None:
                    fit = self._fits(before, piece)
                if fit:
                    append(piece)
                    break
            else:
                return

    def _extend_sums(self, word: str, shared: int, pieces: list[str], sums: list[float]) -> None:
        """As ``_extend_merges``, by the best sum of scores."""
        ids, endings = self.ids, self.endings
        for end in range(shared + 1, len(word) + 1):
            if word[end - 1] not in ids:
                pieces.append(word[end - 1])
                sums.append(sums[-1] + self.worst)
                continue
            best, most = None, 0.0
            for start in range(end - 1, -1, -1):
                piece = word[start:end]
                if piece not in endings:
                    break
                number = ids.get(piece)
                if number is not None and (best is None or sums[start] + self.scores[number] > most):
                    best, most = piece, sums[start] + self.scores[number]
            pieces.append(best)
            sums.append(most)

    def _blank_runs(self, words: list[str], out: dict[str, bytes]) -> None:
        """Words behind a run of marks: the last mark belongs to the word if it merges with it, the others to the run."""
        if not self.period:
            out.update({w: self._pack(self.merged(w)) for w in words})
            return
        ends = {w: w.lstrip(MARK) for w in words}
        single = self.encode_words(sorted({MARK + e for e in ends.values() if e}))
        mark = self.packed.get(MARK)
        for word, end in ends.items():
            tail = single[MARK + end] if end else b""
            marks = len(word) - len(end) - (1 if end else 0)
            if tail and tail[:4] == mark:
                marks, tail = marks + 1, tail[4:]
            whole = max(0, (marks - 2 * self.period) // self.period)
            out[word] = self._pack([MARK * self.period] * whole + self.runs[marks - whole * self.period]) + tail

    def _pack(self, parts: list[str]) -> bytes:
        """The ids of pieces and of characters outside of the vocabulary as 32-bit numbers."""
        out: list[int] = []
        for p in parts:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out.extend(self.bytes[b] for b in p.encode("utf-8", "surrogatepass"))
            else:
                out.append(self.unknown)
        return np.array(out, dtype=np.int32).tobytes()

    def _cut(self, unit: str) -> list[str]:
        """The parts of a word that no piece reaches over; a run of marks stays with what follows."""
        pairs, out, at = self.pairs, [], 0
        first = len(unit) - len(unit.lstrip(MARK)) if unit[1:2] == MARK else 0
        for i in range(max(1, first + 1), len(unit)):
            if unit[i - 1:i + 1] not in pairs:
                out.append(unit[at:i])
                at = i
        out.append(unit[at:])
        return out

    def _units(self, text: str) -> tuple[bool, list[str]]:
        """The words of a text. Where blanks stand alone, a split does: a word stands for itself behind a mark, and one
        that starts with a line break for itself without. Else (True) marked words are cut out by pattern."""
        if not text:
            return False, []
        if "  " in text or text[0] == " " or MARK in text or not self.lines:
            return True, self.unit.findall(MARK + text.replace(" ", MARK))
        return False, text.replace("\n", " \n").split(" ")

    def learn(self, texts: list[str]) -> None:
        """Encode the distinct words of ``texts`` that are not known yet, all in one walk, and remember them."""
        gc.disable()  # the walk makes millions of small objects and no cycles
        try:
            self._learn(texts)
        finally:
            gc.enable()

    def _learn(self, texts: list[str]) -> None:
        if len(self.known[0]) + len(self.known[1]) > KNOWN_WORDS:
            self.known = {}, {}
        fresh: tuple[set[str], set[str]] = set(), set()
        for text in texts:
            marked, words = self._units(text)
            fresh[marked].update(words)
        cuts = []
        for known, words, marked in zip(self.known, fresh, (False, True)):
            for w in words:
                if w not in known:
                    unit = w if marked or w[:1] == "\n" else MARK + w
                    cuts.append((known, w, [unit] if w.isalpha() else self._cut(unit)))
        raw = self.encode_words(list({p for _, _, ps in cuts for p in ps}))
        for known, w, ps in cuts:
            known[w] = raw[ps[0]] if len(ps) == 1 else b"".join(map(raw.__getitem__, ps))

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts. A blank goes before a text that is not empty; blanks become marks."""
        self.learn(texts)
        out = []
        for text in texts:
            marked, words = self._units(text)
            out.append(np.frombuffer(b"".join(map(self.known[marked].__getitem__, words)), dtype=np.int32))
        return out

    def decode(self, ids) -> str:
        """The text of ``ids``: marks become blanks, the first one goes, control pieces and numbers out of range are
        skipped, bytes that form no character become U+FFFD."""
        ids = np.asarray(ids, dtype=np.int64)
        ids = ids[(ids >= 0) & (ids < len(self.names))]
        if not self.high[ids].any():
            text = "".join(map(self.shown.__getitem__, ids.tolist()))
            return text[1:] if text[:1] == " " else text
        out, raw = [], bytearray()
        for i in ids.tolist():
            if i in self.from_byte:
                raw.append(self.from_byte[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.shown[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        text = "".join(out)
        return text[1:] if text[:1] == " " else text


def _slices(batch: pd.DataFrame, column: str, most: int):
    """Parts of a batch with at most so many characters (or one row), so that long texts need bounded memory."""
    ends = batch[column].str.len().cumsum() // most
    for _, part in batch.groupby(ends, sort=False):
        yield part


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", merges: bool = True,
           keep_text: bool = False, verify: bool = False) -> DataFrame:
    """``id_col, ids`` (array of int) for every row, in place and without a shuffle; other columns are left out.

    With ``keep_text`` also the text; with ``verify`` also ``round_trip``: whether the ids decode to the text again (marks
    in it read as blanks), checked in the same task. ``model_path`` names a model file on the driver; its bytes (about half
    a megabyte) travel with the tasks. A null text is the empty one and has no ids. Repeated rows are encoded once per
    batch and returned each.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    rows = docs.select(F.col(id_col), text_of(text_col).alias(text_col))
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        pieces = Pieces.load(model, merges)
        for batch in batches:
            for part in _slices(batch, text_col, SLICE):
                texts = list(part[text_col])
                ids = pieces.encode_batch(texts)
                out = {id_col: part[id_col], "ids": ids}
                if keep_text:
                    out[text_col] = texts
                if verify:
                    out["round_trip"] = np.array([pieces.decode(i) == t.replace(MARK, " ") for i, t in zip(ids, texts)], dtype=bool)
                yield frame(out)

    shape = f"`{id_col}` {kind}, ids array<int>" + f", `{text_col}` string" * keep_text + ", round_trip boolean" * verify
    return rows.mapInPandas(run, shape)


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of ``ids_col`` as ``out_col``; null ids give the empty text."""
    with open(model_path, "rb") as f:
        model = f.read()

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = Pieces.load(model)
        for ids in batches:
            yield pd.Series([pieces.decode([] if i is None else i) for i in ids], dtype=object)

    return encoded.withColumn(out_col, text(F.col(ids_col)))
