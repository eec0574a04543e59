"""Connected components of a graph whose edges stay distributed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: each node that has an edge, and the smallest node that it can reach.

    Large-star and small-star rounds in turn, the edges checkpointed after each.  A node's
    smallest neighbour is a partial aggregate, cut and joined back to its edges, so that a node with
    very many edges is split over tasks by the skew join and never gathered.
    """
    e = cut(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    mark = _mark(e)
    while mark[0]:
        both = e.union(e.select(F.col("v"), F.col("u")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m")))
        large = (
            e.select(F.col("v").alias("c"), F.col("u").alias("far"))
            .join(low, F.col("c") == F.col("x"))
            .select(F.col("far").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        large = cut(large)
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), "m"))
        small = (
            large.join(least, F.col("u") == F.col("x"))
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        e = cut(small)
        now = _mark(e)
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index that each of n items reaches by the pairs."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        was = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if np.array_equal(root, was):
            break
    return root
