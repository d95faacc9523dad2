"""How well two aligned corpora, or languages in one pool, match in vector space."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fewlabel.functions.vectors import cosine, unit
from fewlabel.operators.knn import knn_fold
from fewlabel.session import durable

BLOCK = 4096


def _triangle(pairs: DataFrame, strict: bool) -> DataFrame:
    """Blocks of consecutive positions to (pos, tri, a, b): the sum of a_i . b_j over the pairs
    with j <= i (j < i when strict) inside the block, and the block's vector sums."""
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        a = np.stack(pdf["a"].to_numpy()).astype(np.float64)
        b = np.stack(pdf["b"].to_numpy()).astype(np.float64)
        run = np.cumsum(b, axis=0) - (b if strict else 0.0)
        return pd.DataFrame({"pos": [int(pdf["block"].iloc[0])], "tri": [float((a * run).sum())],
                             "a": [a.sum(0)], "b": [b.sum(0)]})

    blocked = pairs.withColumn("block", F.floor(F.col("pos") / BLOCK))
    return blocked.groupBy("block").applyInPandas(fold, "pos long, tri double, a array<double>, b array<double>")


def alignment_score(left: DataFrame, right: DataFrame, pos: str = "pos", vec: str = "embedding") -> DataFrame:
    """mean(diagonal) - mean(lower triangle) of the cosine matrix of two aligned corpora.

    Positions run from 0 without gaps. The triangle is summed from running vector sums, block by
    block and then over the blocks' sums, so no pair of rows is ever formed. As in the
    definition, the triangle sum is divided by all n * n cells.
    """
    pairs = durable(left.select(F.col(pos).alias("pos"), unit(vec).alias("a"))
                    .join(right.select(F.col(pos).alias("pos"), unit(vec).alias("b")), "pos"), "aligned")
    n = pairs.count()
    from fewlabel.functions.vectors import dot
    diagonal = pairs.agg(F.avg(dot("a", "b")).alias("v")).scalar()
    level, size, total = pairs, n, None
    strict = False
    while True:
        level = durable(_triangle(level.select("pos", "a", "b"), strict), "triangle")
        part = level.agg(F.coalesce(F.sum("tri"), F.lit(0.0)).alias("v")).scalar()
        total = part if total is None else total + part
        size = math.ceil(size / BLOCK)
        strict = True
        if size <= 1:
            break
    lower = total / F.lit(float(max(n, 1)) ** 2)
    return (left.sparkSession.range(1)
            .select(diagonal.alias("mean_diagonal"), lower.alias("mean_lower"))
            .withColumn("alignment", F.col("mean_diagonal") - F.col("mean_lower")))


# Depths of the cross-lingual report and the number of top hits left out.
DEPTHS = [10, 20, 30, 40, 50, 100, 200, 300, 400, 500, 1000, 2000]
OFFSET = 6


def crosslingual_retrieval(queries: DataFrame, pool: DataFrame, lang: str, depths: Sequence[int] = tuple(DEPTHS),
                           metric: str = "l2", offset: int = OFFSET) -> DataFrame:
    """Mean share of hits in other languages whose id is also hit in ``lang``, for each depth.

    pool: ``vec_id, sent_id, language, embedding``. One ranking serves all depths: a hit counts from the
    depth at which both it and its counterpart are in. Hits are counted in the tasks that rank them.
    """
    pool = pool.select("vec_id", "sent_id", (F.col("language") == lang).alias("at_home"), "embedding")

    def count(carried, hits):
        sent = pc.fill_null(carried["sent_id"].combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        home, away = (pc.fill_null(pc.equal(carried["at_home"], side), False).to_numpy() for side in (True, False))
        found = np.zeros(len(depths), dtype=np.int64)
        for group, rank, place in hits:
            known = (rank > offset) & (sent[place] >= 0)
            rank, place, pair = rank[known], place[known], group[known] * (sent.max() + 1) + sent[place[known]]
            at_home, other = home[place], away[place]
            pairs, first = np.unique(pair[at_home], return_index=True)  # hits come by rank, so the first is the closest
            if not len(pairs):
                continue
            at = np.minimum(np.searchsorted(pairs, pair[other]), len(pairs) - 1)
            both = pairs[at] == pair[other]
            depth = np.maximum(rank[other][both], rank[at_home][first[at[both]]]) - offset
            found += np.searchsorted(np.sort(depth), depths, side="right")
        yield pa.RecordBatch.from_arrays([pa.array([found])], names=["found"])

    parts = knn_fold(queries, pool, max(depths) + offset, count, "found array<bigint>", metric=metric, carry=["sent_id", "at_home"])
    found = parts.agg(F.struct(*[F.coalesce(F.sum(F.col("found")[i]), F.lit(0)).alias(f"k{k}") for i, k in enumerate(depths)]).alias("f"))
    n = queries.agg(F.count(F.lit(1)).alias("n"))
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"f.k{k}").alias("found")) for k in depths])
    return (found.select(F.inline(rows)).withColumn("_n", n.scalar())
            .select("k", F.bround(F.try_divide(F.col("found"), F.col("_n") * F.col("k")), 3).alias("share")))


def pairwise_cosine(left: DataFrame, right: DataFrame, pos: str = "pos", vec: str = "embedding") -> DataFrame:
    """Cosine of aligned rows."""
    a = left.select(pos, F.col(vec).alias("_a"))
    b = right.select(pos, F.col(vec).alias("_b"))
    return a.join(b, pos).select(pos, cosine("_a", "_b").alias("similarity"))
