"""Perplexity under a bigram model that is counted from the rows themselves."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fewlabel.functions.signals import words
from fewlabel.session import durable, spread

START = "<s>"
PACK_WORDS = 250_000  # words of a pack of texts; a longer text is a pack of its own
BUCKET_WORDS = 2_000_000  # words a bucket stands for; its counts are at most as many
PAIR, FIRST = 0, 1  # what is counted: pairs of neighbouring words, and words


def packs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(pack, keys, sizes, words): the 64-bit hashes of the words of many texts, one after the other, with each text's
    number of words. Keys travel as texts, so that null ones keep their words in the counts. Blank texts are in no pack."""
    hashes = F.transform(words(text), lambda w: F.xxhash64(w))
    rows = spread(df.select(key, text)).where(F.col(text).isNotNull()).select(F.col(key).cast("string").alias(key), hashes.alias("_words")).where(F.size("_words") > 0)

    schema = T.StructType([T.StructField("keys", T.ArrayType(T.StringType())),
                           T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("words", T.BinaryType())])

    def listed(column, starts):
        return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), column)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            size = pc.list_value_length(batch.column("_words")).to_numpy().astype(np.int64)
            word = batch.column("_words").flatten().to_numpy().astype("<i8", copy=False)
            ends = np.cumsum(size)
            last = np.flatnonzero(np.diff((ends - size) // PACK_WORDS)) + 1
            starts, cuts = np.r_[0, last, len(size)], np.r_[0, ends[last - 1], ends[-1]]
            yield pa.RecordBatch.from_arrays(
                [listed(batch.column(key), starts), listed(pa.array(size), starts),
                 pa.array([word[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())], names=["keys", "sizes", "words"])

    # Written, so that the numbers of the packs stay the same.
    return durable(rows.mapInArrow(run, schema).withColumn("pack", F.monotonically_increasing_id()), "packs")


def _items(sizes: np.ndarray, data: bytes, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word of a pack: the hash of the pair with the word before, of the word before, and of the word."""
    word = np.frombuffer(data, dtype="<u8")
    before = np.r_[np.uint64(0), word[:-1]]
    before[np.cumsum(sizes) - sizes] = np.uint64(start)
    mixed = before * np.uint64(0x9E3779B97F4A7C15) + word
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return mixed ^ (mixed >> np.uint64(31)), before, word


def _counted(pair: np.ndarray, before: np.ndarray, word: np.ndarray) -> list:
    """(kind, distinct hashes in ascending order, how often each comes first, how often at all) of pairs and words."""
    pairs, n = np.unique(pair, return_counts=True)
    both, place = np.unique(np.concatenate([before, word]), return_inverse=True)
    return [(PAIR, pairs, n, n), (FIRST, both, np.bincount(place[:len(before)], minlength=len(both)),
                                  np.bincount(place[len(before):], minlength=len(both)))]


def _asked(texts: DataFrame, start: int, bits: int) -> DataFrame:
    """(bucket, kind, pack, items, firsts, all): a pack's distinct pairs and words with their counts, cut by the leading bits of the hash."""
    def run(batches):
        for batch in batches:
            for pack, sizes, data in zip(batch["pack"], batch["sizes"], batch["words"]):
                out = []
                for kind, items, firsts, alls in _counted(*_items(np.asarray(sizes), data, start)):
                    bucket = (items >> np.uint64(64 - bits)).astype(np.int64)
                    for part in np.split(np.arange(len(items)), np.flatnonzero(np.diff(bucket)) + 1):
                        out.append((int(bucket[part[0]]), kind, pack, items[part].astype("<u8").tobytes(),
                                    firsts[part].astype("<i8").tobytes(), alls[part].astype("<i8").tobytes()))
                yield pd.DataFrame(out, columns=["bucket", "kind", "pack", "items", "firsts", "alls"])

    return texts.select("pack", "sizes", "words").mapInPandas(run, "bucket int, kind int, pack long, items binary, firsts binary, alls binary")


def _answered(asked: DataFrame) -> DataFrame:
    """(pack, kind, bucket, counts, distinct): how often each of a pack's items comes first in all texts, and, once per
    bucket, how many items are words of a text."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        items = [np.frombuffer(b, dtype="<u8") for b in rows["items"]]
        values, place = np.unique(np.concatenate(items), return_inverse=True)

        def total(name):
            n = np.concatenate([np.frombuffer(b, dtype="<i8") for b in rows[name]])
            return np.bincount(place, weights=n, minlength=len(values)).astype(np.int64)
        firsts, edges = total("firsts"), np.cumsum([0, *map(len, items)])
        distinct = np.zeros(len(rows), dtype=np.int64)
        distinct[0] = np.count_nonzero(total("alls"))
        return pd.DataFrame({"pack": rows["pack"], "kind": rows["kind"], "bucket": rows["bucket"], "distinct": distinct,
                             "counts": [firsts[place[a:b]].astype("<i8").tobytes() for a, b in zip(edges, edges[1:])]})

    return asked.groupBy("bucket", "kind").applyInPandas(run, "pack long, kind int, bucket int, distinct long, counts binary")


def perplexity(df: DataFrame, key: str, text: str, add_k: float = 1.0) -> DataFrame:
    """(key, perplexity) of every row; a blank text has infinite perplexity.

    The texts travel as packs of word hashes. A pack sends its distinct pairs and words with their counts to buckets by hash,
    which add them up and send back the totals, and then scores its texts. So an item arrives once per pack, however frequent
    it is, and a task holds a pack or a bucket. Words and pairs are told apart by 64 bits.
    """
    texts = packs(df, key, text)
    n_words = texts.select(F.length("words") / 8).agg(F.sum("(length(words) / 8)")).first()[0] or 0
    bits = max(1, math.ceil(math.log2(max(1, n_words / BUCKET_WORDS))))
    start = df.sparkSession.range(1).select(F.xxhash64(F.lit(START))).first()[0] % 2 ** 64
    # Shuffled explicitly: buckets and packs are few large rows, which adaptive execution would put into few tasks.
    cores = df.sparkSession.sparkContext.defaultParallelism
    answers = durable(_answered(_asked(texts, start, bits).repartition(max(2 ** bits, cores), "bucket", "kind")), "answers")
    vocabulary = answers.where(F.col("kind") == FIRST).agg(F.sum("distinct")).first()[0] or 0

    def score(pack: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        out = []
        for keys, sizes, data in zip(pack["keys"], pack["sizes"], pack["words"]):
            pair, before, word = _items(np.asarray(sizes), data, start)
            replies = replies.sort_values(["kind", "bucket"])
            counts = [np.frombuffer(b"".join(replies["counts"][replies["kind"] == kind]), dtype="<i8") for kind in (PAIR, FIRST)]
            c = counts[PAIR][np.unique(pair, return_inverse=True)[1]]
            both = np.unique(np.concatenate([before, word]))
            c_prev = counts[FIRST][np.searchsorted(both, before)]
            log_p = np.log((c + add_k) / (c_prev + add_k * vocabulary))
            starts = np.cumsum(sizes) - sizes
            out.append(pd.DataFrame({key: pd.Series(list(keys), dtype=object), "_sum": np.add.reduceat(log_p, starts), "_n": sizes}))
        return pd.concat(out)

    schema = T.StructType([T.StructField(key, T.StringType()), T.StructField("_sum", T.DoubleType()), T.StructField("_n", T.LongType())])
    tasks = max(2 ** bits, cores)
    scored = (texts.repartition(tasks, "pack").groupBy("pack")
              .cogroup(answers.select("pack", "kind", "bucket", "counts").repartition(tasks, "pack").groupBy("pack"))
              .applyInPandas(score, schema))
    value = scored.groupBy(F.col(key).cast(df.schema[key].dataType).alias(key)).agg(F.exp(-F.sum("_sum") / F.sum("_n")).alias("perplexity"))
    return df.select(key).join(value, key, "left").withColumn(
        "perplexity", F.coalesce("perplexity", F.lit(float("inf"))))


def rank_by_perplexity(scored: DataFrame, key: str) -> DataFrame:
    """Most unusual first, with an explicit place."""
    from fewlabel.functions.ordering import rank_in_group
    return rank_in_group(scored, [], [F.desc("perplexity"), F.col(key)], "place")
