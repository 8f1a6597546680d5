"""Connected components of a graph that no single machine holds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n-1 and edges (a, b): each node's smallest reachable node."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(v, root)`` for every node of ``edges`` (columns u, v: long) but the roots.

    Large-star and small-star rounds: minima are pre-aggregated before each shuffle and hung onto
    the edges by joins that Spark can split, so neither a node with very many edges nor a very large
    component meets in one task. Rounds go on until the edges stay as they are; each round is
    checkpointed. ``root`` is the smallest node of the component.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()

    def mark(df: DataFrame) -> tuple:
        r = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        return r[0], r[1]

    edges = cut(edges)
    now = mark(edges)
    for _ in range(rounds):
        if not now[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # cut, so that a join deals both its sides anew and Spark can split the edges of one node
        least = cut(both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")).withColumn("m", F.least("m", "k")))
        large = (
            both.join(least, both.u == least.k).where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        large = cut(large)
        least = cut(large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")))
        joined = large.join(least, large.u == least.k)
        small = (
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
        edges = cut(small)
        was, now = now, mark(edges)
        if was == now:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("v"), F.col("v").alias("root"))
