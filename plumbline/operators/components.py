"""Connected components over an edge table by alternating star contraction.

Every round is two grouped minima and two joins, so no group is ever gathered: grouped minima combine
on the map side and a hub's edges are an ordinary skewed join, which AQE splits. Each round is written
to the shared folder; the number of rounds grows with the logarithm of the graph.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from plumbline.operators.stash import discard, stash


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge to another; component = smallest node reached.

    Nulls and self loops are dropped, directions and repeats do not matter, any orderable type works.
    Nodes without an edge are not returned: their component is the node itself.
    """
    e = (
        edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
        .where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    e, seen = _written(e, "cc-edges")
    for _ in range(max_rounds):
        if not seen[0]:
            break
        large = stash(_large_star(e), "cc-large")
        small, now = _written(_small_star(large), "cc-small")
        discard(large)
        discard(e)
        e = small
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _written(e: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """The written table of edges, with their number and a sum of their hashes, taken while they are written."""
    seen = Observation()
    out = stash(e.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), name)
    return out, (seen.get["n"], seen.get["h"])


def _large_star(e: DataFrame) -> DataFrame:
    """Every neighbour larger than a node moves to the smallest of the node and its neighbours."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """A node and all its smaller neighbours move to the smallest neighbour."""
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
