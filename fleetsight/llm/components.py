"""Connected components of an edge table, and small helpers for tiles.

Large-star / small-star rounds (Kiveris et al., "Connected components in
MapReduce and beyond"): each round is two partial aggregations (the smallest
neighbour per vertex) and two joins, so a vertex that a third of the edges
touch is never gathered in one task. Every round ends in a checkpoint in the
shared folder, so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsight.session import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v) with u < v."""
    if large:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("m").alias("u"), "v")
    else:
        # v with its smaller neighbours: all of them, and v itself, hang on the smallest
        low = edges.groupBy("v").agg(F.min("u").alias("m"))
        out = edges.join(low, "v").select(F.col("m").alias("u"), F.col("u").alias("v")).unionAll(
            low.select(F.col("m").alias("u"), "v"))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root): the smallest vertex reachable, for every vertex of ``edges`` (u, v; any order).

    Null ends and loops are left out; an edge may repeat.
    """
    now = cut_lineage(edges.where(F.col("u") != F.col("v")).select(
        F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    while True:
        after = cut_lineage(_star(_star(now, True), False))
        # converged when every edge is a star's ray: no centre is also a ray
        rays = after.groupBy("v").agg(F.count("*").alias("n")).withColumnRenamed("v", "x")
        moved = rays.where("n > 1").limit(1).count() or after.join(
            rays, after["u"] == rays["x"], "left_semi").limit(1).count()
        if not moved:
            break
        now = after
    return after.select(F.col("v").alias("vertex"), F.col("u").alias("root")).unionAll(
        after.select(F.col("u").alias("vertex"), F.col("u").alias("root")).distinct())


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n places over the links (i, j), inside one task."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        open_ = a != b
        if not open_.any():
            break
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while not np.array_equal(root, root[root]):
            root = root[root]
    return root
