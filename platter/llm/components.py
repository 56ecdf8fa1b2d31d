"""Connected components by alternating large-star and small-star, over tables of edges.

Labels are the smallest node of each component. Every round is one grouped
window over edges; a node with many neighbours never becomes one row: the
least neighbour comes from an aggregate and is joined back, so a hot node is
split by adaptive skew joins like any other key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platter.llm._common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Each neighbour v > u of u is linked to the least node in u's closed neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.where("v > u")
        .join(least, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Of u > v: u and its lesser neighbours are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return (
        down.join(least, "u")
        .select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        .where("u != v")
        .distinct()
    )


def components(edges: DataFrame, scratch: Scratch, name: str = "cc", most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that an edge (u, v) names; component is its least node.

    Self loops, repeated and reversed edges and edges with a null end change
    nothing; no edges give no rows. Each round is written to the shared folder.
    """
    now = edges.where("u is not null and v is not null and u != v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    now = scratch.table(now.distinct(), f"{name}-0")
    digest = None
    for n in range(1, most_rounds + 1):
        last, now = now, scratch.table(_small_star(_large_star(now)), f"{name}-{n}")
        # Equal edge sets: the same count and the same sums of two hashes.
        new = now.agg(
            F.count("*"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
            F.sum(F.hash("u", "v").cast("decimal(38,0)")),
        ).first()
        scratch.drop(f"{name}-{n - 1}")
        if new == digest or new[0] == 0:
            break
        digest = new
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    # Settled: every edge is (node, least node of its component).
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
