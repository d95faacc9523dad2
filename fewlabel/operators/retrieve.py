"""Retrieval of labelled rows from a pool: for a whole query set, per query, or at random."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fewlabel.functions.ordering import hash_key, hash_rank
from fewlabel.functions.scaling import min_max
from fewlabel.operators.diversity import mmr, mmr_partitioned
from fewlabel.operators.joins import MAX_BROADCAST_ROWS, join_small
from fewlabel.operators.knn import DIGEST, knn_join
from fewlabel.operators.selection import (
    balance_labels, best_rows, dedup_two_stage, exclude, include, weighted_score)
from fewlabel.session import durable

CLUSTER_ROUNDS = 20  # k-means rounds on the candidates of one query


def candidate_depth(num_retrieved: int, n_queries: int) -> int:
    """Default neighbours per query. Fixed formula."""
    n = max(n_queries, 1)
    return max(math.ceil(2 * num_retrieved / n), math.ceil(2000 / n), 2)


def attach(hits: DataFrame, pool: DataFrame, key: str, columns: Sequence[str], max_hits: int) -> DataFrame:
    """Add pool columns to hits by key. ``max_hits`` is the known upper bound of the hit count:
    within it the hits are broadcast and the pool is scanned in place."""
    side = F.broadcast(hits) if max_hits <= MAX_BROADCAST_ROWS else hits
    return pool.select(key, *[c for c in columns if c not in hits.columns]).join(side, key)


def filtered_pool(pool: DataFrame, exclude_languages=None, exclude_datasets=None,
                  include_languages=None, include_datasets=None) -> DataFrame:
    """Filters go below the search, where they reach the scan."""
    pool = exclude(pool, "lang", exclude_languages)
    pool = exclude(pool, "source", exclude_datasets)
    pool = include(pool, "lang", include_languages)
    return include(pool, "source", include_datasets)


def cluster_sizes(df: DataFrame, vec: str = "embedding", seed: int = 42) -> DataFrame:
    """Size of the k-means cluster of every row; max(n / 100, 50) clusters, at most n."""
    rows = durable(df, "cluster-input")
    n = rows.count()
    if n < 2:
        return rows.withColumn("cluster_size", F.lit(n).cast("long"))
    k = max(2, min(int(max(n / 100, 50)), n))
    model = KMeans(k=k, seed=seed).fit(rows.select(array_to_vector(vec).alias("features")))
    scored = (model.transform(rows.withColumn("features", array_to_vector(vec)))
              .withColumnRenamed("prediction", "cluster").drop("features"))
    sizes = scored.groupBy("cluster").agg(F.count(F.lit(1)).alias("cluster_size"))
    return join_small(scored, sizes, ["cluster"]).drop("cluster")


def cluster_sizes_within(df: DataFrame, within: Sequence[str], key: str, vec: str = "embedding", seed: int = 42) -> DataFrame:
    """Size of the cluster of every row among the rows of its group; the groups are bounded candidate sets.

    max(n / 100, 50) centres, at most n, drawn by a seed from the rows in key order; a row belongs to the first closest.
    """
    def sizes(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable")
        x = np.stack(pdf[vec].to_numpy()).astype(np.float64)
        count = min(max(len(x) // 100, 50), len(x))
        centres = x[np.sort(np.random.default_rng(seed).permutation(len(x))[:count])]
        for _ in range(CLUSTER_ROUNDS):
            home = ((centres ** 2).sum(1)[None, :] - 2 * x @ centres.T).argmin(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, home, x)
            n = np.bincount(home, minlength=count)
            moved = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
            if np.array_equal(moved, centres):
                break
            centres = moved
        return pdf[[*within, key]].assign(cluster_size=np.bincount(home, minlength=count)[home])

    rows = durable(df, "candidates")
    sized = rows.select(*within, key, vec).groupBy(*within).applyInPandas(
        sizes, T.StructType([*[rows.schema[c] for c in (*within, key)], T.StructField("cluster_size", T.LongType())]))
    return rows.join(sized, [*within, key])


def _rescore(rows, weights, within=(), key="doc_id"):
    if weights.get("cluster"):
        rows = cluster_sizes_within(rows, within, key) if within else cluster_sizes(rows)
    return weighted_score(rows, "dist_norm", weights, within=within)


def retrieve_multi(queries: DataFrame, pool: DataFrame, num_retrieved: int, k: int = 0, *,
                   pool_id: str = "doc_id", metric: str = "l2", normalize: bool = False,
                   weights: dict[str, float] | None = None, balance: bool = False,
                   mmr_threshold: float | None = None, lambda_param: float = 0.5, mmr_buckets: int = 1,
                   policy: str = "query_major", deepen: bool = True, **filters) -> DataFrame:
    """Rows retrieved for a whole query set.

    queries: ``query_id, query_vec``; pool: ``pool_id, text, lang, source, label, embedding``
    and optional signal columns. Search, scale distances over all hits, deduplicate, cut to
    three times the request, optionally diversify, re-rank, cut or balance. The depth doubles
    until twice the request is unique or the pool is exhausted.
    """
    weights = weights or {}
    pool = filtered_pool(pool, **filters)
    n_queries = queries.count()
    k = k or candidate_depth(num_retrieved, n_queries)
    order = ["query_id", "rank"] if policy == "query_major" else ["dist", "query_id", "rank"]
    signals = [c for c in ("uncertainty", "margin", "perplexity") if weights.get(c)]
    while True:
        hits = durable(knn_join(queries, pool, k, pool_id=pool_id, metric=metric, normalize=normalize,
                                carry=["lang", "source", "label", *signals], distinct="text"), "hits")
        scaled = min_max(hits, {"dist_norm": "dist"})
        unique = durable(dedup_two_stage(scaled, ["source", pool_id], DIGEST, order), "unique")
        if not deepen or unique.count() >= 2 * num_retrieved or hits.where(F.col("rank") == k).isEmpty():
            break  # deep enough, or every query with a vector has all of the pool
        k *= 2
    rows = best_rows(unique, 3 * num_retrieved, order).drop(DIGEST)
    rows = attach(rows, pool, pool_id, ["text"], 3 * num_retrieved)
    need_vec = mmr_threshold is not None or weights.get("cluster")
    if need_vec:
        rows = durable(attach(rows, pool, pool_id, ["embedding"], 3 * num_retrieved), "candidates")
    if mmr_threshold is not None:
        rows = mmr_partitioned(rows, "embedding", "dist_norm", pool_id, threshold=mmr_threshold,
                               min_remained=num_retrieved, lambda_param=lambda_param, buckets=mmr_buckets)
    rows = _rescore(rows, weights).drop("embedding")
    final = ["score", "query_id", "rank"]
    return balance_labels(rows, num_retrieved, final) if balance else best_rows(rows, num_retrieved, final)


def retrieve_per_query(queries: DataFrame, pool: DataFrame, k: int, *, pool_id: str = "doc_id",
                       metric: str = "l2", normalize: bool = False,
                       weights: dict[str, float] | None = None, balance: bool = False,
                       mmr_threshold: float | None = None, lambda_param: float = 0.5,
                       **filters) -> DataFrame:
    """k rows for each query on its own: the 3k nearest distinct texts, per-query scaling, diversity and re-ranking
    (the cluster criterion within the query's candidates), then the cut; ``position`` is the final place of a row.
    Only a pool with fewer than k distinct texts gives fewer rows."""
    from fewlabel.functions.ordering import top_per_group
    weights = weights or {}
    pool = filtered_pool(pool, **filters)
    n_queries = queries.count()
    within = ["query_id"]
    signals = [c for c in ("uncertainty", "margin", "perplexity") if weights.get(c)]
    need_vec = mmr_threshold is not None or bool(weights.get("cluster"))
    hits = knn_join(queries, pool, 3 * k, pool_id=pool_id, metric=metric, normalize=normalize,
                    carry=["lang", "source", "label", *signals], distinct="text").drop(DIGEST)
    hits = min_max(hits, {"dist_norm": "dist"}, within)
    columns = ["text", *(["embedding"] if need_vec else [])]
    hits = attach(hits, pool, pool_id, columns, n_queries * 3 * k)
    rows = dedup_two_stage(hits, ["source", pool_id], "text", ["rank"], within)
    if mmr_threshold is not None:
        rows = mmr(rows, within, "embedding", "dist_norm", pool_id, threshold=mmr_threshold,
                   min_remained=k, lambda_param=lambda_param)
    rows = _rescore(rows, weights, within, pool_id).drop("embedding")
    final = ["score", "rank"]
    if balance:
        rows = balance_labels(rows, k, final, within=within)
    return top_per_group(rows, within, final, k, "position")


def retrieve_random(pool: DataFrame, num_retrieved: int, *, pool_id: str = "doc_id", seed: int = 0,
                    weights: dict[str, float] | None = None, balance: bool = False,
                    mmr_threshold: float | None = None, lambda_param: float = 0.5, mmr_buckets: int = 1,
                    **filters) -> DataFrame:
    """A seeded random draw of max(2n, 100) pool rows, deduplicated, re-ranked and cut."""
    weights = weights or {}
    pool = filtered_pool(pool, **filters).withColumn("_all", F.lit(0))
    size = max(2 * num_retrieved, 100)
    drawn = hash_rank(pool, ["_all"], hash_key(pool_id, seed=str(seed)), size, "rank")
    drawn = drawn.withColumn("dist_norm", F.lit(0.0))
    rows = durable(dedup_two_stage(drawn, ["source", pool_id], "text", ["rank"]), "drawn")
    if mmr_threshold is not None:
        rows = mmr_partitioned(rows, "embedding", "dist_norm", pool_id, threshold=mmr_threshold,
                               min_remained=num_retrieved, lambda_param=lambda_param, buckets=mmr_buckets)
    rows = _rescore(rows.drop("_all"), weights).drop("embedding")
    final = ["score", "rank"]
    return balance_labels(rows, num_retrieved, final) if balance else best_rows(rows, num_retrieved, final)
