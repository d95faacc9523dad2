"""Gradient training against plain numpy loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fewlabel.operators import gradient


def data(seed, n=120, d=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = (x @ rng.normal(size=d) + rng.normal(size=n) > 0).astype(int)
    return x, y


def frame(spark, x, y, **more):
    names = list(more)
    rows = [(i, [float(v) for v in x[i]], int(y[i]), *[more[c][i] for c in names]) for i in range(len(y))]
    kinds = {"source": "int", "score": "double"}
    return spark.createDataFrame(rows, ", ".join(["id long", "embedding array<double>", "label int", *[f"{c} {kinds[c]}" for c in names]]))


def plain(x, y, start, rounds, reg, step, pull=0.0, towards=None):
    """One model, row by row in the order of the formulas."""
    x = np.hstack([x, np.ones((len(x), 1))])
    mask = np.append(np.ones(x.shape[1] - 1), 0.0)
    now = ahead = start.copy()
    for t in range(1, rounds + 1):
        g = sum((1 / (1 + np.exp(-r @ ahead)) - v) * r for r, v in zip(x, y)) / len(y)
        new = (ahead - step * g + (step * pull * towards if pull else 0)) / (1 + step * (pull + reg * mask))
        now, ahead = new, new + (t - 1) / (t + 2) * (new - now)
    return now


def step_of(x):
    return 4 / (1 + (x * x).sum(axis=1).max())


def test_grid_equals_separate_fits_and_a_plain_loop(spark):
    x, y = data(1)
    rows = gradient.prepare(frame(spark, x, y).repartition(3))
    points = [(0.001, 4), (0.001, 12), (0.3, 12)]
    got = gradient.descend(rows, gradient.zeros(rows, 3), [n for _, n in points], [r for r, _ in points])
    for j, (reg, n) in enumerate(points):
        assert np.allclose(got[:, j], plain(x, y, np.zeros(5), n, reg, step_of(x)), atol=1e-9)
        assert np.allclose(got[:, [j]], gradient.descend(rows, gradient.zeros(rows), [n], [reg]), atol=1e-9)


def test_sweep_counts_votes_of_every_point(spark):
    x, y = data(2)
    df = frame(spark, x, y)
    got = {(r["reg"], r["iterations"]): r["f1_macro"] for r in gradient.sweep_fit(df, df, [0.01, 1.0], [2, 6]).collect()}
    assert set(got) == {(0.01, 2), (0.01, 6), (1.0, 2), (1.0, 6)}
    for (reg, n), f1 in got.items():
        w = plain(x, y, np.zeros(5), n, reg, step_of(x))
        pred = (np.hstack([x, np.ones((len(x), 1))]) @ w > 0).astype(int)
        parts = [2 * ((pred == c) & (y == c)).sum() / ((pred == c).sum() + (y == c).sum()) for c in (0, 1)]
        assert abs(f1 - sum(parts) / 2) < 1e-9


def test_order_of_epochs_matters(spark):
    x, y = data(3, 60)
    source = [i % 3 and 1 for i in range(60)]
    score = [float(i) for i in range(60)]
    df = frame(spark, x, y, source=source, score=score)
    epochs, passes, reg = 4, 2, 0.01
    got = gradient.train_in_epochs(df, epochs, "linear", passes=passes, reg=reg)[:, 0]
    late = [i for i in range(60) if source[i]]
    order = [[i for i in range(60) if not source[i]] + late[:len(late) * e // (epochs - 1)] for e in range(epochs)]

    def run(plan):
        w = np.zeros(5)
        for rows in plan:
            w = plain(x[rows], y[rows], w, passes, reg, step_of(x))
        return w

    assert np.allclose(got, run(order), atol=1e-9)
    # The same rows as often, the other way round, give another model.
    assert np.abs(run(order) - run(order[::-1])).max() > 1e-3


@pytest.mark.parametrize("pull", [0.0, 0.5, float("inf")])
def test_continued_training(spark, pull):
    x, y = data(4)
    first = np.arange(5.0)[:, None] / 5
    got = gradient.continue_training(first, frame(spark, x, y), pull, reg=0.1, iterations=8)
    if np.isinf(pull):
        assert (got == first).all()
    else:
        assert np.allclose(got[:, 0], plain(x, y, first[:, 0], 8, 0.1, step_of(x), pull, first[:, 0]), atol=1e-9)


def test_without_pull_the_start_is_forgotten_and_rows_without_label_stay_out(spark):
    x, y = data(5, 40, 2)
    df = frame(spark, x, y).withColumn("label", F.when(F.col("id") < 30, F.col("label"))).unionByName(
        spark.createDataFrame([(99, None, 1)], "id long, embedding array<double>, label int"))
    far = gradient.continue_training(np.full((3, 1), 2.0), df, 0.0, reg=0.5, iterations=110)
    assert np.allclose(far, gradient.fit(df, reg=0.5, iterations=110), atol=1e-3)
    assert np.allclose(far[:, 0], plain(x[:30], y[:30], np.zeros(3), 400, 0.5, step_of(x[:30])), atol=1e-3)
    nobody = df.where("id < 0")
    assert gradient.fit(nobody, iterations=2).shape == (1, 1)
    scored = gradient.score(far, df.where("embedding IS NOT NULL")).select("probs", "pred").collect()
    assert all(abs(sum(r["probs"]) - 1) < 1e-12 and r["pred"] == (r["probs"][1] > 0.5) for r in scored)
