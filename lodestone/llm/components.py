"""Connected components as a few rounds of joins and minima (alternating large and small stars)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import discard, stored


def _minimum_star(pairs: DataFrame) -> DataFrame:
    """For pairs (u, v): each v of a u, and u itself, paired with the least of them all."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _minimum_star(both).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    stars = _minimum_star(down)
    return stars.select(F.col("v").alias("u"), F.col("m").alias("v")).union(stars.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """The least vertex reachable from each vertex of edges (u, v): vertex, component.

    Edges have no direction; loops and repeated edges don't matter; no edges give
    no rows.  Each round is a written table, so a lost executor costs a round at
    most, and only a count and a checksum come to the driver.
    """
    edges = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v")
    before = None
    for _ in range(rounds):
        old, edges = edges, stored(_small_star(_large_star(edges)), "star")
        discard(old)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).first()
        if now == before or not now.n:
            return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
