"""Exact top-k inner products with a vector-approximation file.

Every vector gets a small cell code per component. A query first scans the codes, which bound its score from
above, and then reads exact vectors in the order of the bounds until the k-th score cannot be beaten.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fewlabel.session import durable

LEVELS = 64  # cells per component


def integer_vector(vector: Column, scale: float = 64.0) -> Column:
    """``floor(scale * x)`` of every component as a double; null if the vector or a component is null or not finite."""
    wide = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    def odd(x):
        return x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    return F.when(vector.isNotNull() & ~F.exists(vector, odd), wide)


def _codes(exact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell numbers, and per component the lower edge and width of a cell."""
    low = exact.min(axis=0)
    width = np.maximum((exact.max(axis=0) - low) / LEVELS, 1e-300)
    return np.minimum((exact - low) / width, LEVELS - 1).astype(np.uint8), low, width


def _exact_scores(vectors: np.ndarray, query: np.ndarray, small: bool) -> np.ndarray:
    if small:  # every product and sum is a whole number that a double holds
        return (vectors @ query).astype(np.int64)
    return (vectors.astype(np.int64) * query.astype(np.int64)).sum(axis=1)


def search_block(ids: np.ndarray, exact: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of one block of vectors for every query: ``query_id, vec_id, score``, ties to the smaller id.

    A code bounds a component to its cell, so the score is at most the centre's score plus half a cell per component.
    The bounds of all codes come from one matrix product; exact vectors are read in the order of their bounds, in steps
    that double, until the next bound is below the k-th best score.
    """
    codes, low, width = _codes(exact)
    centres = (codes + 0.5) * width + low
    reach = np.abs(queries) @ (width / 2)
    top = float(np.abs(exact).max(initial=0)) * float(np.abs(queries).max(initial=0)) * exact.shape[1]
    small = top < 2 ** 53
    slack = 1e-9 * (top + 1)
    parts = []
    for at in range(0, len(queries), 64):
        bounds = queries[at:at + 64] @ centres.T + reach[at:at + 64, None] + slack
        for row, bound in enumerate(bounds):
            qid, query = query_ids[at + row], queries[at + row]
            bound[ids == qid] = -np.inf  # a query is no candidate of its own
            best_ids, best = ids[:0], np.empty(0, dtype=np.int64)
            unread, done, want = np.ones(len(ids), dtype=bool), 0, min(len(ids), max(4 * k, 64))
            order = np.argpartition(-bound, want - 1)[:want]
            following = -np.inf if want == len(ids) else np.partition(-bound, want)[want] * -1
            while True:
                fresh = order[done:want] if done == 0 else order[:want][unread[order[:want]]]
                unread[fresh] = False
                fresh = fresh[np.isfinite(bound[fresh])]
                scores = np.concatenate([best, _exact_scores(exact[fresh], query, small)])
                names = np.concatenate([best_ids, ids[fresh]])
                keep = np.lexsort((names, -scores))[:k]
                best, best_ids = scores[keep], names[keep]
                if want == len(ids) or len(best) == k and following < best[-1]:
                    break
                if done == 0:
                    order = np.argsort(-bound, kind="stable")
                done, want = want, min(len(ids), 4 * want)
                following = bound[order[want]] if want < len(ids) else -np.inf
            parts.append(pd.DataFrame({"query_id": qid, "vec_id": best_ids, "score": best}))
    return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "vector",
          block: int = 32_768, query_block: int = 32_768) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of ``vectors`` with the highest inner product for every query row.

    Both inputs hold an integer id and an array of whole doubles. Rows of the query's own id are no candidates; with
    fewer than k candidates all are returned; ties go to the smaller id. Null vectors, empty ones and null ids take no
    part, and a query meets vectors of its own length only. Repeated ids count per row as candidates; as a query the
    first of them by content is taken. Other columns are left out.

    Vectors and queries are dealt into even blocks by a hash of the id. A task holds one block of each (at most about
    ``block`` and ``query_block`` rows, times two for uneven hashing) and returns k rows per query, which one ranked
    merge reduces. Queries beyond ``query_block`` make more blocks of their own; nothing passes through the driver.
    """
    usable = (F.size(vector_col) > 0) & F.col(id_col).isNotNull()
    vectors = durable(vectors.where(usable).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"),
                                                   F.size(vector_col).alias("d")), "vectors")
    queries = durable(queries.where(usable).groupBy(F.col(id_col).cast("long").alias("id"))
                      .agg(F.min(vector_col).alias("v")).withColumn("d", F.size("v")), "queries")
    blocks = -(-max(vectors.count(), 1) // block)
    rounds = -(-max(queries.count(), 1) // query_block)
    dealt = vectors.select("*", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("b"),
                           F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("r"))
    asked = queries.select("*", F.pmod(F.xxhash64("id"), F.lit(rounds)).cast("int").alias("r"),
                           F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return search_block(left["id"].to_numpy(), np.stack(left["v"].to_numpy()),
                            right["id"].to_numpy(), np.stack(right["v"].to_numpy()), k)

    found = dealt.groupBy("d", "b", "r").cogroup(asked.groupBy("d", "b", "r")).applyInPandas(
        meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
