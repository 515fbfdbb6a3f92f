"""Connected components over an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklens.llm.common import drop, stage


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n items over the pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
        if np.array_equal(before, label):
            break
    return label


def _star(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over (v, m) with v > m.

    Each step is an aggregation that merges on the map side and an equi join that adaptive execution
    can split, so a hub with very many links is never one task's list.
    """
    both = edges.unionByName(edges.select(F.col("m").alias("v"), F.col("v").alias("m")))
    low = both.groupBy("v").agg(F.min("m").alias("low"))
    low = low.select("v", F.least("v", "low").alias("low"))
    large = both.filter(F.col("m") > F.col("v")).join(low, "v").select(F.col("m").alias("v"), F.col("low").alias("m"))
    large = large.filter(F.col("v") != F.col("m")).distinct()
    least = large.groupBy("v").agg(F.min("m").alias("low"))
    paired = large.join(least, "v")
    moved = paired.select(F.col("m").alias("v"), F.col("low").alias("m")).filter(F.col("v") != F.col("m"))
    return moved.unionByName(least.select("v", F.col("low").alias("m"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with a link; component is its smallest reachable node.

    Nodes are longs. Links with a null end, and links of a node to itself, say nothing and are left
    out; repeated links count once. No links: no rows. Each round is written to the shared folder
    and the one before deleted; rounds grow with the logarithm of the longest path.
    """
    now = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m")).distinct()
    now = stage(now, "links")
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark or not seen[0]:
            break
        mark = tuple(seen)
        after = stage(_star(now), "links")
        drop(now)
        now = after
    roots = now.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct()
    return now.select(F.col("v").alias("node"), F.col("m").alias("component")).unionByName(roots)
