"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconloom.session import materialise

ROUNDS = 100


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to the smallest one near it, itself included."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("low"))
    others = down.join(least, "a").where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return others.unionByName(least.select("a", F.col("low").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) of every linked node but the roots themselves.

    ``links`` are rows (a, b) of longs with a != b, in any order and number.  The number of rounds grows with the
    logarithm of the longest path; each round is written to the shared folder, which cuts lineage.
    """
    edges, mark = materialise(links, "links"), None
    for _ in range(ROUNDS):
        edges = materialise(_small_star(_large_star(edges)), "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if now == mark or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
