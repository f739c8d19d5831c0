"""Connected components of a graph of integer ids, by alternating star contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import cut

#: Links in a checkpoint's file, about, and files at least: a small graph in hundreds of files costs more than its rounds.
LINKS, FILES = 50_000, 8


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in edges (a, b); component is the smallest id reachable.

    Null ends and self-links say nothing and are left out; repeated and reversed links
    count once; without links the result is empty. A large star links the neighbours of
    a node that are greater than it to its smallest neighbour, a small star the others.
    Minima are pre-aggregated before their shuffle; the joins that bring them back have
    plain keys, so adaptive execution can split the rows of a hub. Every round ends in a
    checkpoint, and no ids go to the driver.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u is not null and v is not null and u > v")
    now = cut(pairs.distinct())
    last = None
    while True:  # star contraction stands still after O(log^2 n) rounds
        mark = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if mark == last or not mark[0]:
            break
        last = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        # neighbours above a node: its links in which it is the smaller end
        large = now.join(low, now["v"] == low["w"]).select("u", F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        small = large.join(least, large["u"] == least["w"]).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v")
        now = cut(small.distinct().coalesce(max(FILES, mark[0] // LINKS)))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def forest(n: int, links: np.ndarray) -> np.ndarray:
    """Links (k x 2, indices below n) reduced to one from each node to the least node of its component."""
    parent = np.arange(n)
    a, b = links[:, 0], links[:, 1]
    while len(a):
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    child = np.flatnonzero(parent != np.arange(n))
    return np.stack([child, parent[child]], 1)
