"""Grid search over re-ranking weights and over diversity settings, scored by neighbour votes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fewlabel.functions.ordering import top_per_group
from fewlabel.operators.metrics import classification_metrics
from fewlabel.operators.diversity import greedy, relevance_of
from fewlabel.session import durable


def vote(chosen: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Majority label of each query's rows against its true label; a tie counts as 1."""
    votes = chosen.groupBy(*keys, "query_id").agg(
        (F.sum("label") * 2 >= F.count(F.lit(1))).cast("int").alias("pred"))
    return votes.join(truth.select("query_id", F.col("label")), "query_id")


def sweep_weights(candidates: DataFrame, truth: DataFrame, criteria: Sequence[str],
                  weights: Sequence[float], sizes: Sequence[int]) -> DataFrame:
    """Macro-F1 for every combination of criterion weights (sum at most 1) and result size.

    candidates: one scored row per (query, neighbour) with ``dist_norm`` and the scaled criteria.
    Every grid point is a column expression over the one candidate table.
    """
    grid = [[]]
    for _ in criteria:
        grid = [g + [float(w)] for g in grid for w in weights]
    grid = [g for g in grid if sum(g) <= 1.0]
    points = F.array(*[F.struct(*[F.lit(w).alias(f"w_{c}") for c, w in zip(criteria, g)]) for g in grid])
    rows = candidates.select("*", F.inline(points))
    rest, extra = F.lit(1.0), F.lit(0.0)
    for c in criteria:
        rest = rest - F.col(f"w_{c}")
        extra = extra + F.col(f"w_{c}") * F.col(c)
    names = [f"w_{c}" for c in criteria]
    ranked = top_per_group(rows.withColumn("score", rest * F.col("dist_norm") + extra),
                           ["query_id", *names], ["score", "rank"], max(sizes), "place")
    chosen = (ranked.withColumn("top_n", F.explode(F.array(*[F.lit(n) for n in sizes])))
              .where("place <= top_n"))
    keys = [*names, "top_n"]
    return classification_metrics(vote(chosen, truth, keys), by=keys).select(*keys, "f1_macro")


def best_point(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The grid point with the highest macro-F1, the smallest parameters on ties."""
    return scores.orderBy(F.desc("f1_macro"), *keys).limit(1)


def sweep_diversity(candidates: DataFrame, truth: DataFrame, thresholds: Sequence[float],
                    lambdas: Sequence[float], size: int, vec: str = "embedding", key: str = "doc_id") -> DataFrame:
    """Macro-F1 for every (threshold, lambda); candidates are bounded per query.

    A query's candidates travel once; its task selects for all points.
    """
    points = [(float(t), float(l)) for t in thresholds for l in lambdas]

    def select(pdf):
        pdf = pdf.sort_values(key).reset_index(drop=True)
        vectors = np.stack(pdf[vec].to_numpy()).astype(np.float64)
        relevance = relevance_of(pdf["dist_norm"].to_numpy())
        place = np.empty(len(pdf), dtype=np.int64)
        place[np.lexsort((pdf[key].to_numpy(), pdf["dist_norm"].to_numpy()))] = np.arange(len(pdf))
        chosen = []
        for threshold, weight in points:
            picked = greedy(vectors, relevance, threshold, size, weight)
            chosen.append(picked[np.argsort(place[picked])][:size])
        counts = [len(c) for c in chosen]
        rows = np.concatenate(chosen)
        return pd.DataFrame({"query_id": pdf["query_id"].to_numpy()[rows], "label": pdf["label"].to_numpy()[rows],
                             "threshold": np.repeat([t for t, _ in points], counts),
                             "lambda": np.repeat([w for _, w in points], counts)})

    rows = durable(candidates, "sweep").select("query_id", key, vec, "dist_norm", "label")
    kept = rows.groupBy("query_id").applyInPandas(
        select, "query_id long, label int, threshold double, lambda double")
    keys = ["threshold", "lambda"]
    return classification_metrics(vote(kept, truth, keys), by=keys).select(*keys, "f1_macro")
