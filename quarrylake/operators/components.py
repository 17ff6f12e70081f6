"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.storage import discard, stash


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over stashed distinct (u, v) with u > v: neighbours are hung on the least node of the neighbourhood.

    The large step moves the greater neighbours of every node, the small step moves the smaller ones and the node.
    Minima are written and joined back. That join reads written tables on both sides, so Spark broadcasts minima that are
    small and cuts the part of a hub where they are not; a hub's neighbours meet neither in one row nor in one task.
    """
    if large:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stash(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "components")
        moved = edges.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = stash(edges.groupBy("u").agg(F.min("v").alias("m")), "components")
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    hung = stash(moved.where("u <> v").distinct(), "components")
    discard(least)
    return hung


def connected_components(edges: DataFrame, left: str = "u", right: str = "v", max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable, for every node that has an edge to another node.

    Alternating large-star and small-star steps until the edge set stands still; each round is written to the shared
    folder, so lineage stays short. Null ends, self loops and repeated edges are ignored. An empty table gives an empty
    result. Raises RuntimeError instead of returning labels that have not converged.
    """
    a, b = F.col(left), F.col(right)
    current = stash(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "components",
    )
    seen = _mark(current)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        hung = _star(current, large=True)
        following = _star(hung, large=False)
        mark = _mark(following)
        discard(current, hung)
        current = following
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components have not converged in {max_rounds} rounds")
    leaves = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """A fingerprint of an edge set that does not depend on row order."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.s
