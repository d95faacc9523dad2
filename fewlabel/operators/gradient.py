"""Logistic regression by gradient passes over the rows; several models are the columns of one weight matrix.

A pass is one job: tasks multiply their batches with all columns at once and hand out one gradient each, which are added
by partial aggregation. Only weights and gradients, whose size the caller chooses, reach the driver. Between passes the
weights are the driver's, so a later pass can see other rows, start from another model or be pulled towards one.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fewlabel.functions.vectors import arg_max, as_double
from fewlabel.operators import curriculum
from fewlabel.operators.metrics import classification_metrics
from fewlabel.session import durable


def prepare(df: DataFrame, vec: str = "embedding", label: str = "label", weight: str | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """``x, y, w`` and the ``carry`` columns, written once because every pass reads them. Rows without vector or label stay out."""
    rows = df.where(F.col(vec).isNotNull() & F.col(label).isNotNull())
    return durable(rows.select(as_double(vec).alias("x"), F.col(label).cast("double").alias("y"),
                               (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), *carry), "gradient-rows")


def _with_one(column: pa.ListArray) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return np.hstack([x, np.ones((len(x), 1))])


def gradient(rows: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, float]:
    """The sum over ``rows`` of w x (p - y) for every column of ``weights`` (the last row is the bias), and the sum of w."""
    size = weights.size

    def run(batches):
        total, mass = np.zeros_like(weights), 0.0
        for b in batches:
            if b.num_rows:
                x, w = _with_one(b.column("x")), b.column("w").to_numpy()
                off = 1 / (1 + np.exp(-np.clip(x @ weights, -500, 500))) - b.column("y").to_numpy()[:, None]
                total += x.T @ (off * w[:, None])
                mass += w.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array(np.append(total.ravel(), mass))], ["at", "part"])

    out = np.zeros(size + 1)
    for r in rows.select("x", "y", "w").mapInArrow(run, "at long, part double").groupBy("at").agg(F.sum("part").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out[:size].reshape(weights.shape), out[size]


def safe_step(rows: DataFrame) -> float:
    """A step below one over the curvature of the mean loss, from the longest vector."""
    longest = rows.agg(F.max(F.aggregate("x", F.lit(1.0), lambda a, v: a + v * v))).first()[0]
    return 4.0 / (longest or 4.0)


def descend(rows: DataFrame, start: np.ndarray, iterations: Sequence[int], regs: Sequence[float], step: float | None = None,
            pull: float = 0.0, towards: np.ndarray | None = None) -> np.ndarray:
    """Accelerated gradient passes from ``start``: column j runs ``iterations[j]`` of them with penalty ``regs[j]``.

    All columns share the passes, so a grid costs as many passes as its longest point. The penalty (half of reg times the squared
    weights, bias not counted) and the pull (half of ``pull`` times the squared distance to ``towards``) are solved
    exactly in every step: an infinite ``pull`` gives ``towards`` itself.
    """
    towards = start if towards is None else towards
    if np.isinf(pull):
        return towards.copy()
    step = safe_step(rows) if step is None else step
    shrink = np.outer(np.append(np.ones(len(start) - 1), 0.0), np.asarray(regs, dtype=float))
    rounds = np.asarray(iterations)
    now, ahead = start.copy(), start.copy()
    for t in range(1, rounds.max(initial=0) + 1):
        total, mass = gradient(rows, ahead)
        if not mass:
            break
        new = (ahead - step * total / mass + step * pull * towards) / (1 + step * (pull + shrink))
        new = np.where(t <= rounds, new, now)
        now, ahead = new, new + (t - 1) / (t + 2) * (new - now)
    return now


def zeros(rows: DataFrame, columns: int = 1) -> np.ndarray:
    first = rows.select(F.size("x").alias("d")).first()
    return np.zeros(((first["d"] if first else 0) + 1, columns))


def fit(df: DataFrame, vec: str = "embedding", reg: float = 0.01, iterations: int = 30, weight: str | None = None) -> np.ndarray:
    rows = prepare(df, vec, weight=weight)
    return descend(rows, zeros(rows), [iterations], [reg])


def train_in_epochs(train: DataFrame, epochs: int, schedule: str, key: str = "id", vec: str = "embedding",
                    reg: float = 0.01, passes: int = 3) -> np.ndarray:
    """Curriculum training: every epoch makes ``passes`` over the rows of its slice and hands its weights to the next one.

    Rows are kept once, with the epochs they belong to. An epoch without rows changes nothing.
    """
    seen = (curriculum.slices(train.select(key, "source", "score"), epochs, schedule, key)
            .groupBy("source", key).agg(F.collect_set("epoch").alias("epochs")))
    rows = prepare(train.join(seen, ["source", key]), vec, carry=["epochs"])
    weights, step = zeros(rows), safe_step(rows)
    for epoch in range(epochs):
        weights = descend(rows.where(F.array_contains("epochs", epoch)), weights, [passes], [reg], step)
    return weights


def continue_training(first: np.ndarray, second: DataFrame, pull: float, vec: str = "embedding", reg: float = 0.01,
                      iterations: int = 30) -> np.ndarray:
    """Transfer: a fit on ``second`` that starts from the weights of the first stage and is pulled towards them."""
    return descend(prepare(second, vec), first, [iterations], [reg], pull=pull, towards=first)


def probability(weights: np.ndarray, vec: str = "embedding") -> Column:
    """The probability of label 1 for a single model, as an expression."""
    w = weights[:, 0].tolist()
    dot = F.aggregate(F.zip_with(as_double(vec), F.array(*[F.lit(v) for v in w[:-1]]), lambda a, b: a * b), F.lit(w[-1]), lambda a, v: a + v)
    return 1 / (1 + F.exp(-dot))


def score(weights: np.ndarray, df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Add ``probs`` and ``pred`` like the other classifiers."""
    p = probability(weights, vec)
    return df.withColumn("probs", F.array(1 - p, p)).withColumn("pred", arg_max(F.col("probs")))


def sweep_fit(train: DataFrame, evaluation: DataFrame, regs: Sequence[float], iterations: Sequence[int],
              vec: str = "embedding") -> DataFrame:
    """Macro-F1 of the classifier for every (regularisation, iterations): one pass over the data per iteration for all points,
    and one over the evaluation rows, which vote with every column."""
    points = [(float(r), int(n)) for r in regs for n in iterations]
    rows = prepare(train, vec)
    weights = descend(rows, zeros(rows, len(points)), [n for _, n in points], [r for r, _ in points])

    def run(batches):
        for b in batches:
            if b.num_rows:
                votes = (_with_one(b.column("x")) @ weights > 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(len(points), dtype=np.int32), b.num_rows)),
                     pa.array(np.repeat(b.column("y").to_numpy().astype(np.int32), len(points))), pa.array(votes.ravel())], ["point", "label", "pred"])

    voted = prepare(evaluation, vec).mapInArrow(run, "point int, label int, pred int")
    names = evaluation.sparkSession.createDataFrame([(i, r, n) for i, (r, n) in enumerate(points)], "point int, reg double, iterations int")
    return (classification_metrics(voted, by=["point"]).join(F.broadcast(names), "point")  # one row per grid point
            .select("reg", "iterations", "f1_macro"))
