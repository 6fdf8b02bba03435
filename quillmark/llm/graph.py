"""Connected components of a distributed edge list, by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import least_of, materialize


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """node, root for every node of edges (a long, b long, a != b): root is the smallest node that it reaches.

    Each round is written to the shared folder, so that a lost executor costs one round; rounds end as soon as every component is a star, which edges may
    be from the start. One boolean a round reaches the driver.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    for _ in range(rounds):
        if _stars(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now = materialize(_small_star(_large_star(now)), "components")
    raise RuntimeError(f"components have not settled in {rounds} rounds")


def _stars(edges: DataFrame) -> bool:
    """Whether each a has one b, and none is a b itself. With a > b, that b is the smallest node of its component."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).union(edges.select(F.col("b").alias("node"), F.lit(0).alias("up")))
    told = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return told.filter("ups > 1 or (ups = 1 and least = 0)").isEmpty()


def _large_star(e: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to its smallest one. A star's hub has as many rows as leaves, so its rows are dealt by the other end too."""
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return least_of(both, "u", "v", "m", F.col("v")).filter("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the smallest of them."""
    near = least_of(e, "a", "b", "m", F.col("b"))
    return near.select(F.when(F.col("b") > F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b")).distinct()


def union_find(n: int, pairs) -> np.ndarray:
    """The smallest member of each one's component, for pairs given in blocks (two index arrays each)."""
    parent = np.arange(n)
    for a, b in pairs:
        while len(a):
            a, b = parent[a], parent[b]
            apart = a != b
            a, b = a[apart], b[apart]
            if not len(a):
                break
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
    return parent
