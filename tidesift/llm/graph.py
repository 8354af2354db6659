"""Connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .base import drop_stash, stash


def _large_star(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links every larger neighbour of a node to the least of the node and its neighbours.

    The minimum combines before it shuffles. It is stashed, so that both sides of the join are plain exchanges, whose skewed
    partitions adaptive execution splits: a node with a third of all links is no one task.
    """
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stash(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m")))
    return both.where("v > u").join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"), least


def _small_star(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links a node and its smaller neighbours to the least of them; made as the large star is, so that a node with many is no one task."""
    least = stash(links.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), "m"))
    others = links.join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return others.unionByName(least.select(F.col("_u").alias("u"), F.col("m").alias("v"))), least


def connected_components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """node, component (its smallest reachable node) for the nodes of links (a, b); links in any order, repeats allowed.

    Alternating large-star and small-star steps: the number of links never grows and their depth falls by a constant
    factor. Links are stashed after each round; nothing but their count and a sum of hashes reaches the driver.
    """
    now = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    mark, old = None, None
    for _ in range(rounds):
        seen = Observation()
        stars, least = _large_star(now)
        stars = stash(stars)
        drop_stash(least)
        closer, least = _small_star(stars)
        after = stash(closer.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31))).alias("sum")))
        found = seen.get
        drop_stash(least)
        drop_stash(stars)
        if old is not None:
            drop_stash(old)
        now = old = after
        if found == mark:
            break
        mark = found
    else:
        raise RuntimeError(f"components not closed after {rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
