"""Density clusters against a plain walk over the cells, and counts of windows against a plain slide."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from fewlabel.operators import density, topics


def plain(vectors, length, dims, width, min_share, min_rows):
    """Topics by a walk from dense cell to dense cell."""
    signs = density.directions(length, dims)
    def cell(v):
        if v is None or len(v) != length or any(x is None or not math.isfinite(x) for x in v):
            return None
        return tuple(math.floor(sum(s * x for s, x in zip(d, v)) / width) for d in signs)
    at = [cell(v) for v in vectors]
    count = Counter(c for c in at if c is not None)
    dense = {c for c, n in count.items() if n >= min_share * sum(count.values())}
    def touch(a, b):
        return all(abs(x - y) <= 1 for x, y in zip(a, b))
    group = {}
    for start in sorted(dense):
        todo = [start]
        while todo:
            c = todo.pop()
            if c not in group:
                group[c] = start
                todo += [d for d in dense if touch(c, d)]
    home = {}
    for c in count:
        near = [c] if c in dense else sorted((d for d in dense if touch(c, d)), key=lambda d: (-count[d], d))
        if near:
            home[c] = group[near[0]]
    sizes = Counter()
    for c, g in home.items():
        sizes[g] += count[c]
    number = {g: i for i, g in enumerate(sorted((g for g in sizes if sizes[g] >= min_rows), key=lambda g: (-sizes[g], g)))}
    return [number.get(home.get(c), -1) for c in at]


def blobs(seed, centres, rows, length=6):
    rng = np.random.default_rng(seed)
    return [(rng.normal(size=length) * 0.4 + np.resize(c, length)).tolist() for c in centres for _ in range(rows)]


@pytest.mark.parametrize("dims,width,share,least", [(2, 0.4, 0.01, 5), (3, 0.8, 0.01, 10), (1, 0.1, 0.02, 1)])
def test_density_topics(spark, dims, width, share, least):
    vectors = blobs(dims, [(3, 0, 1), (-3, 1, 0), (0, 4, -4)], 120)
    vectors += [[50.0 * i] * 6 for i in range(1, 4)]  # far from all others
    vectors += [None, [], [1.0] * 5, [1.0] * 5 + [None], [float("nan")] * 6, [float("inf")] * 6, [1e300] * 6]
    rows = spark.createDataFrame(list(enumerate(vectors)), "id long, v array<double>").selectExpr(
        "*", "'old' AS topic", "1 AS cell", "2 AS n", "3 AS component")
    out = density.density_topics(rows, "v", 6, dims, width, share, least)
    assert sorted(out.columns) == sorted(rows.columns)
    got = {r["id"]: r["topic"] for r in out.collect()}
    usable = [v if v is None or not any(x and abs(x) > 1e15 for x in v) else None for v in vectors]
    assert got == dict(enumerate(plain(usable, 6, dims, width, share, least)))
    assert got[len(vectors) - 1] == got[len(vectors) - 7] == topics.OUTLIER


def test_one_hot_cell_and_empty_table(spark):
    rows = spark.range(5000).selectExpr("id", "array(CAST(IF(id < 4900, 0.0, 9.0) AS DOUBLE), 0.0D) AS v")
    out = density.density_topics(rows, "v", 2, 2, 0.5)
    assert {(r["topic"], r["count"]) for r in out.groupBy("topic").count().collect()} == {(0, 4900), (1, 100)}
    assert density.density_topics(rows.limit(0), "v", 2, 2, 0.5).count() == 0
    with pytest.raises(ValueError):
        density.density_topics(rows, "v", 2, min_share=0.0)


@pytest.mark.parametrize("window", [1, 3, 110])
def test_window_counts(spark, window):
    rng = random.Random(window)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([0, 1, 2, 5, 200]))) for _ in range(60)] + [None, " \n "]
    listed = {"a", "c", "d", "absent"}
    want = Counter()
    for text in texts:
        seq = (text or "").split()
        for at in range(max(1, len(seq) - window + 1)):
            if text is not None:
                held = sorted(listed & set(seq[at:at + window]))
                want.update([("", "")] + [(x, y) for i, x in enumerate(held) for y in held[i:]])
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = topics.window_counts(rows, listed, window=window).collect()
    assert {(r["word_a"], r["word_b"]): r["n"] for r in got} == want
