"""Ranked lexical search: postings term at a time, rarest first, with a limited set of accumulators."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fewlabel.llm.common import text_of
from fewlabel.session import durable, spread

# ASCII letters in lower case, every ASCII character but letters and digits a blank; other bytes stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
SLICE = 1 << 20  # bytes of a text taken apart at a time
BLOCK_TERMS = 200_000  # item terms that travel to the tasks together


def slices(text: str):
    """The terms of a text in order, as lists for slices of about a megabyte."""
    data = text.encode("utf-8").translate(FOLD)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + SLICE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def term_counts(text: str) -> tuple[Counter, int]:
    """How often each term occurs, and how many terms there are with repeats."""
    counts, total = Counter(), 0
    for words in slices(text):
        counts.update(words)
        total += len(words)
    return counts, total


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """``item, term``: each term of an item once. Rows of one id are one item, which has the terms of them all."""
    rows = items.select(F.col(item_col).cast("long").alias("item"), text_of(text_col).alias("text"))

    def run(batches):
        for b in batches:
            item, term = [], []
            for i, text in zip(b.column("item").to_pylist(), b.column("text").to_pylist()):
                found = sorted(term_counts(text)[0])
                item += [i] * len(found)
                term += [t.decode("utf-8") for t in found]
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(term, pa.string())], ["item", "term"])

    return rows.mapInArrow(run, "item long, term string").distinct()


def postings(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n, terms, tfs`` for every row with a term: its number of terms, and the asked terms in it with their counts."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))

    def run(batches):
        for b in batches:
            kept, sizes, ends, terms, tfs = [], [], [0], [], []
            for row, text in enumerate(b.column("text")):
                counts, total = term_counts(text.as_py())
                if not total:
                    continue
                for t in counts.keys() & vocabulary.keys():
                    terms.append(vocabulary[t])
                    tfs.append(counts[t])
                kept.append(row)
                sizes.append(total)
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(kept, pa.int32())), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    return spread(rows).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


class Index:
    """Postings of one batch by term: ``rows[start[t]:start[t + 1]]`` hold term t, and add ``gains`` of the same places."""

    def __init__(self, batch: pa.RecordBatch, weights: np.ndarray, n_docs: int, n_terms: int):
        ids = batch.column("doc_id")
        self.unnamed = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        m = 50 + 50 * batch.column("n").to_numpy() * n_docs // n_terms
        listed = batch.column("terms")
        sizes = np.diff(listed.offsets.to_numpy())
        term = listed.flatten().to_numpy()
        tf = batch.column("tfs").flatten().to_numpy()
        row = np.repeat(np.arange(len(sizes)), sizes)
        gain = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[row]))
        order = np.argsort(term, kind="stable")
        self.rows, self.gains = row[order], gain[order]
        self.start = np.searchsorted(term[order], np.arange(len(weights) + 1))
        self.bound = np.zeros(len(weights), dtype=np.int64)
        held = np.flatnonzero(np.diff(self.start))
        if len(held):
            self.bound[held] = np.maximum.reduceat(self.gains, self.start[held])

    def scores(self, terms: np.ndarray, k: int, known: int) -> np.ndarray:
        """Scores by row, exact for every row that can be among the best ``k``; ``terms`` come rarest first.

        ``known`` is a score that k rows of earlier batches reach. A row that has no accumulator when a term's turn
        comes can gain the bounds of that term and the later ones at most. Once that is below the kth partial score
        (or ``known``), no new accumulator is made, and the later terms only add to those there are.
        """
        acc = np.zeros(len(self.ids), dtype=np.int64)
        rest = np.cumsum(self.bound[terms][::-1])[::-1]
        least, growing = known, True
        for j, t in enumerate(terms):
            rows, gains = self.rows[self.start[t]:self.start[t + 1]], self.gains[self.start[t]:self.start[t + 1]]
            if growing and rest[j] < least:
                growing = False
            elif growing and 0 < rest[j] < rest[0] - rest[j]:  # else no partial score can exceed what is to come
                made = acc[acc > 0]
                if len(made) >= k:
                    least = max(least, int(np.partition(made, len(made) - k)[len(made) - k]))
                    growing = rest[j] >= least
            if growing:
                acc[rows] += gains
            else:
                had = acc[rows] > 0
                acc[rows[had]] += gains[had]
        return acc


def _best(k: int, score, unnamed, ids):
    order = np.lexsort((ids, unnamed, -score))[:k]
    return score[order], unnamed[order], ids[order]


def rank_block(found: DataFrame, items: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``slot, doc_id, score``: of every task the ``k`` best rows for each item; a task holds k rows per item and one batch."""
    none = np.zeros(0, dtype=np.int64)

    def run(batches):
        best = [(none, none.astype(bool), none)] * len(items)
        for batch in batches:
            if not batch.num_rows:
                continue
            index = Index(batch, weights, n_docs, n_terms)
            for slot, terms in enumerate(items):
                score, unnamed, ids = best[slot]
                known = int(score[-1]) if len(score) == k else 0
                acc = index.scores(terms[index.bound[terms] > 0], k, known)
                rows = np.flatnonzero(acc >= max(known, 1))
                if len(rows) > k:
                    least = np.partition(acc[rows], len(rows) - k)[len(rows) - k]
                    rows = rows[acc[rows] >= least]
                if len(rows):
                    best[slot] = _best(k, np.concatenate([score, acc[rows]]), np.concatenate([unnamed, index.unnamed[rows]]),
                                       np.concatenate([ids, index.ids[rows]]))
        for slot, (score, unnamed, ids) in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), slot, dtype=np.int32)), pa.array(ids, mask=unnamed),
                                              pa.array(score)], ["slot", "doc_id", "score"])

    return found.mapInArrow(run, "slot int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", item_col: str = "item_id",
           text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every item, equal scores by ascending id.

    Terms are runs of ASCII letters and digits and all other characters above ASCII, ASCII letters in lower case. A term of
    weight w = floor(1000 ln((2N + 2) / (2 df + 1))) adds w * (10^9 tf div (1000 tf + 20 m)) with
    m = 50 + 50 n N div L, all in whole numbers; documents of score 0 are left out.

    The documents are read once for a block of items (``block_terms`` terms, spread by the item's hash): a task writes how
    often the asked terms occur in each text. The written counts give document frequencies and lengths by partial
    aggregation, and are then searched batch by batch; a task carries its k best rows an item from batch to batch, and
    one ranking joins the tasks' rows. Neither texts nor postings are shuffled, so no term and no text is a hot key.

    Null and empty texts have no terms: such documents are in no count, such items get no row. Repeated documents are ranked
    one by one; null ids come last among equal scores. Rows that share an item id are one item with the terms of all of them.
    """
    spark = docs.sparkSession
    asked = durable(item_terms(items, item_col, text_col), "item-terms")
    blocks = max(1, math.ceil(asked.count() / block_terms))
    results = None
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        rows = mine.select(F.col("item").cast("string"), "term").toPandas()
        names = sorted(set(rows["term"]))
        found = durable(postings(docs, {t.encode("utf-8"): i for i, t in enumerate(names)}, id_col, text_col), "postings")
        total = found.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
        n_docs, n_terms = total["n"], total["l"]
        df = np.zeros(len(names), dtype=np.int64)
        for r in found.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
            df[r["t"]] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)
        number = {t: i for i, t in enumerate(names)}
        slots, lists = [], []
        for item, group in rows.groupby("item", dropna=False):
            terms = np.array([number[t] for t in group["term"]], dtype=np.int64)
            slots.append(int(item) if isinstance(item, str) else None)
            lists.append(terms[np.lexsort((terms, df[terms]))])
        ids = spark.createDataFrame(list(enumerate(slots)), "slot int, item_id long")
        part = rank_block(found, lists, weights, n_docs, n_terms, k)
        order = Window.partitionBy("slot").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        part = part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(F.broadcast(ids), "slot")
        part = part.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        results = part if results is None else results.unionByName(part)
    return results
