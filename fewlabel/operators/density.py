"""Density clusters with outliers: dense cells of a grid over projected vectors, joined where they touch."""

from __future__ import annotations

import itertools
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fewlabel.functions.ordering import rank_in_group
from fewlabel.functions.vectors import as_double, dot
from fewlabel.operators.joins import join_small
from fewlabel.operators.topics import OUTLIER
from fewlabel.session import durable

LARGEST_CELL = float(2 ** 53)  # cell numbers beyond are no whole doubles


def directions(length: int, dims: int) -> list[list[float]]:
    """``dims`` sign vectors: a component counts positive where crc32 of 'direction:component' is even."""
    return [[1.0 if zlib.crc32(f"{d}:{i}".encode()) % 2 == 0 else -1.0 for i in range(length)] for d in range(dims)]


def cell_of(vector, length: int, dims: int, width: float) -> Column:
    """The grid cell of a projected vector; null for a null vector, one of another length or with odd components."""
    at = [F.floor(dot(vector, F.lit(d)) / width) for d in directions(length, dims)]
    inside = [F.abs(dot(vector, F.lit(d)) / width) < LARGEST_CELL for d in directions(length, dims)]
    known = F.forall(as_double(vector), lambda x: x.isNotNull() & ~F.isnan(x))
    for i in inside:
        known = known & i
    return F.when((F.size(vector) == length) & known, F.array(*at))


def _around(cell: str, dims: int) -> Column:
    """The cells that touch ``cell``, and itself."""
    steps = F.array(*[F.array(*[F.lit(s).cast("long") for s in step]) for step in itertools.product((-1, 0, 1), repeat=dims)])
    return F.transform(steps, lambda step: F.zip_with(cell, step, lambda c, s: c + s))


def _components(edges: DataFrame) -> DataFrame:
    """``a, component``: the smallest cell reachable. ``edges`` hold both directions and every cell itself.

    Every round takes the smallest label of the neighbours' labels, so paths shrink by halves.
    """
    labels = durable(edges.groupBy("a").agg(F.min("b").alias("component")), "labels")
    while True:
        jumped = labels.select(F.col("a").alias("b"), F.col("component").alias("c")).join(
            labels.select(F.col("a").alias("c"), F.col("component").alias("best")), "c").select("b", "best")
        after = durable(edges.join(jumped, "b").groupBy("a").agg(F.min("best").alias("component")), "labels")
        if after.join(labels, ["a", "component"], "left_anti").isEmpty():
            return after
        labels = after


def density_topics(df: DataFrame, vector: str = "embedding", length: int = 64, dims: int = 2, width: float = 0.25,
                   min_share: float = 0.005, min_rows: int = 10) -> DataFrame:
    """``df`` with ``topic``: its density cluster, numbered from the largest (ties by smallest cell), or ``OUTLIER``.

    Vectors are projected onto ``dims`` fixed sign vectors and fall into cells of ``width``. A cell with at least
    ``min_share`` of the rows that have a cell is dense; dense cells that touch, by a corner too, are one cluster. A
    sparse cell belongs to the touching dense cell with the most rows (ties: the smallest cell), or to none.
    Clusters below ``min_rows`` rows are outliers, as are rows without a usable vector. An existing ``topic`` is replaced.

    ``df`` is scanned twice and never shuffled by row: only counts per cell are. There are at most
    ``1 / min_share`` dense cells, so whatever follows the counts has that size, times ``3 ** dims``.
    """
    if min_share <= 0:
        raise ValueError("min_share must be positive")
    rows = df.drop("topic").withColumn("_cell", cell_of(vector, length, dims, width))
    cells = durable(rows.where(F.col("_cell").isNotNull()).groupBy(F.col("_cell").alias("cell"))
                    .agg(F.count(F.lit(1)).alias("n")), "cells")
    total = cells.agg(F.sum("n").alias("t"))
    dense = durable(cells.where(F.col("n") >= F.lit(float(min_share)) * total.scalar()), "dense")

    near = dense.select(F.col("cell").alias("core"), F.col("n").alias("core_n"), F.explode(_around("cell", dims)).alias("cell"))
    edges = durable(near.join(dense.select("cell"), "cell").select(F.col("core").alias("a"), F.col("cell").alias("b")), "edges")
    component = _components(edges)

    # The cells a dense one reaches: itself first, else the fullest.
    order = F.struct(F.col("core") == F.col("cell"), F.col("core_n"))
    best = near.groupBy("cell").agg(F.max(order).alias("best"))
    reached = (near.join(best, "cell").where(order == F.col("best")).groupBy("cell").agg(F.min("core").alias("a"))
               .join(component, "a").select("cell", "component"))
    held = durable(cells.join(F.broadcast(reached), "cell").select("cell", "component", "n"), "held")
    sizes = held.groupBy("component").agg(F.sum("n").alias("size")).where(F.col("size") >= min_rows)
    numbered = rank_in_group(sizes, [], [F.desc("size"), F.col("component")], "place")
    topics = held.join(numbered, "component").select(F.col("cell").alias("_cell"), (F.col("place") - 1).cast("int").alias("topic"))
    return join_small(rows, topics, ["_cell"], "left").withColumn("topic", F.coalesce("topic", F.lit(OUTLIER))).drop("_cell")
