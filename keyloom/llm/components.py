"""Distributed union-find: connected components of a table of edges by rounds of contraction.

A round lets every node point to its smallest neighbour, shortens the pointers by self-joins and
replaces the edges by edges between the nodes pointed to. Edges inside a component vanish, so the
table shrinks by a factor each round. Everything stays in tables; grouping is by minimum, which is
aggregated before the shuffle, and joins are left to adaptive skew splitting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stash

JUMPS = 2


def connected_components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """(node, root) for each node of edges (a, b) that isn't the smallest of its component.

    Nodes are of any orderable type. Rows with a null end, loops and repeated edges are ignored;
    an empty table gives an empty result. A node without a row is its own root.
    """
    live = (
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("a").isNotNull() & F.col("b").isNotNull()).alias("ok"))
        .where("ok AND a <> b")
        .select("a", "b")
        .distinct()
    )
    live = stash(live, f"{label}-edges")
    roots = None
    while not live.isEmpty():
        point = live.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
        for _ in range(JUMPS):
            point = stash(point, f"{label}-pointers")
            onward = point.select(F.col("node").alias("root"), F.col("root").alias("next"))
            point = point.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        point = stash(point, f"{label}-pointers")
        ends = [point.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in ("a", "b")]
        moved = live.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("a_root", "a").alias("x"), F.coalesce("b_root", "b").alias("y"))
        live = stash(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{label}-edges")
        if roots is None:
            roots = point
        else:
            onward = point.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = stash(roots.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root")).unionByName(point), f"{label}-roots")
    if roots is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # A node whose pointer was not yet short may be pointed to, and so be replaced again in a later round; both ways end at one root.
    return roots.groupBy("node").agg(F.min("root").alias("root"))
