"""Maximal marginal relevance: inside bounded groups, and over a large set as a tree of such groups."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fewlabel.session import durable

MAX_GROUP_ROWS = 60_000  # the largest group one task may hold


def greedy(vectors: np.ndarray, relevance: np.ndarray, threshold: float, min_remained: int,
           lambda_param: float) -> np.ndarray:
    """Positions picked, in pick order; inputs are in key order, so ties go to the lowest key.

    Holds one running maximum similarity per row instead of the full similarity matrix. The
    pass ends at the first pick that is too similar once ``min_remained`` rows are in.
    """
    n = len(relevance)
    if not n:
        return np.empty(0, dtype=int)
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.where(length > 0, length, 1.0)
    picked = [int(np.argmax(relevance))]
    open_rows = np.ones(n, dtype=bool)
    open_rows[picked[0]] = False
    closest = unit @ unit[picked[0]]
    while len(picked) < n:
        value = np.where(open_rows, lambda_param * relevance - (1 - lambda_param) * closest, -np.inf)
        nxt = int(np.argmax(value))
        if len(picked) >= min_remained and closest[nxt] > threshold:
            break
        picked.append(nxt)
        open_rows[nxt] = False
        closest = np.maximum(closest, unit @ unit[nxt])
    return np.asarray(picked)


def relevance_of(score: np.ndarray) -> np.ndarray:
    """Min-max of the negated score; zeros when constant."""
    r = -score.astype(np.float64)
    span = r.max() - r.min() if len(r) else 0.0
    return (r - r.min()) / span if span > 0 else np.zeros_like(r)


def mmr(df: DataFrame, groups: Sequence[str], vec: str, score: str, key: str, *,
        threshold: float | None, min_remained: int, lambda_param: float = 0.5) -> DataFrame:
    """Greedy selection inside each group; the groups are bounded candidate sets.

    ``threshold=None`` or >= 1 keeps everything. Only key, score and vector enter the Python
    task; the survivors are joined back by key. A group beyond ``MAX_GROUP_ROWS`` is an error: what one task can hold
    never decides which rows come out.
    """
    if threshold is None or threshold >= 1:
        return df

    def select(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MAX_GROUP_ROWS:
            raise ValueError(f"{len(pdf)} rows in one group; select in more buckets, or with a lower threshold")
        pdf = pdf.sort_values(key, kind="stable").reset_index(drop=True)
        vectors = np.stack(pdf[vec].to_numpy()).astype(np.float64)
        chosen = greedy(vectors, relevance_of(pdf[score].to_numpy()), threshold, min_remained, lambda_param)
        return pdf.iloc[chosen][[*groups, key]]

    rows = durable(df, "mmr-input")
    schema = rows.select(*groups, key).schema
    kept = rows.select(*groups, key, score, vec).groupBy(*groups).applyInPandas(select, schema)
    return rows.join(kept, [*groups, key], "left_semi")


def bucket_of(key: str, buckets: int):
    """An even bucket number by md5, which every engine can repeat."""
    return F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def mmr_partitioned(df: DataFrame, vec: str, score: str, key: str, *, threshold: float,
                    min_remained: int, lambda_param: float = 0.5, buckets: int = 1, fan: int | None = None) -> DataFrame:
    """Greedy selection over one large set, as a tree of bounded passes.

    The rows are dealt into ``buckets`` leaves by a digest of the unique ``key`` (1: one exact pass). Every node selects by
    itself, in parallel, and keeps its share of ``min_remained`` at least; the survivors of ``fan`` neighbouring nodes
    (default: of all) are the rows of the next level's node, up to the root. Leaves beyond half of what a task may hold
    are halved until they fit, and where the survivors of a node's children would not fit one task, the tree ends with
    the nodes it has: their union holds ``min_remained`` rows or all that are left.
    """
    if threshold is None or threshold >= 1:
        return df
    keys = df.select(key, score, vec)
    total = keys.count()
    while 2 * total > buckets * MAX_GROUP_ROWS and total > MAX_GROUP_ROWS:
        buckets *= 2
    fan = fan or max(2, buckets)
    rows, nodes = keys.withColumn("_bucket", bucket_of(key, buckets)), buckets
    while True:
        rows = durable(mmr(rows, ["_bucket"], vec, score, key, threshold=threshold, lambda_param=lambda_param,
                           min_remained=max(1, min_remained // nodes)), "survivors")
        if nodes == 1:
            break
        rows = rows.withColumn("_bucket", F.floor(F.col("_bucket") / fan).cast("int"))
        if rows.groupBy("_bucket").count().agg(F.max("count")).first()[0] > MAX_GROUP_ROWS:
            break
        nodes = -(-nodes // fan)
    return df.join(rows.select(key), key, "left_semi")
