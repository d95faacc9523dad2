"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fewlabel.session import durable


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node reachable from every other node of ``edges`` (``a, b`` long, either order).

    Alternates two steps until nothing changes: every node hands its larger neighbours to its smallest one, then its
    smaller neighbours too, so long chains shrink by halves. A round is two aggregations whose partial results meet a
    hot node early, and two joins with the written minima, whose skewed keys Spark can split; only the answer whether
    to go on reaches the driver.
    The smallest nodes themselves and nodes of no edge are left out; self loops and repeated edges change nothing.
    """
    links = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    if links.isEmpty():
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    while True:
        # Large step: v's larger neighbours go to the smallest of v and its neighbours.
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = durable(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        large = durable(large, "large")
        # Small step: v's smaller neighbours and v go to the smallest of them.
        least = durable(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
                                              F.col("m").alias("b")).where("a <> b").distinct()
        small = durable(small, "small")
        # Done when every node hangs on one that hangs on nothing.
        open_ = small.join(small.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        more = small.groupBy("a").count().where("count > 1")
        links = small
        if open_.isEmpty() and more.isEmpty():
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
