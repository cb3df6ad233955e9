"""Connected components of a graph whose links are a table, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierlake.workspace import materialize


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root: the smallest node that can be reached, for every node that has a link.

    ``links`` has columns a and b of one type that can be ordered; null ends, loops and repeats are left out. A round
    hangs each node's larger neighbours, then its smaller ones, under the smallest it knows (Kiveris et al. 2014), so
    paths shrink by a power and stars stay. Each round is written to shared storage; sums tell when nothing moves.
    """
    edges = materialize(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    seen = None
    for _ in range(rounds):
        now = edges.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        edges = materialize(_small_star(_large_star(edges)), "links")
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is hung under the smallest of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("least"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour smaller than a node, and the node, are hung under the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    moved = edges.join(least, "u").where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.union(least.select("u", F.col("least").alias("v"))).distinct()
