"""Connected components of a link table, by alternating large-star and small-star rounds on staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from raretide.llm.common import stage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star round. Links are (hi, lo) with hi > lo, without repeats."""
    both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    if large:
        both = both.union(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    # Written, so that the join below is dealt anew and a node with very many links can be split.
    least = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least-neighbours")
    joined = both.join(least, "u")
    if large:  # larger neighbours point to the least of the neighbourhood
        moved = joined.where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    else:  # smaller neighbours and the node itself point to the least
        moved = joined.select(F.col("v").alias("hi"), F.col("m").alias("lo")).union(least.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
    return moved.where("hi > lo").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link: ``root`` is the least node of its component.

    Links may repeat, run in either direction or join a node to itself (such a link alone gives no row). Rounds go on
    until the links form stars around their roots, which takes about the logarithm of the longest path. Minima are
    taken before the shuffle; the join of a node with many links is an ordinary one that Spark can split.
    """
    hi, lo = F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")
    now = stage(links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(hi, lo).where("hi > lo").distinct(), "links")
    while True:
        after = stage(_star(stage(_star(now, True), "links"), False), "links")
        # Done when every node has one link, and it leads to a node that has none upwards.
        roots = after.groupBy("hi").agg(F.count(F.lit(1)).alias("n"))
        open_nodes = roots.where("n > 1").select("hi").union(after.join(after.select(F.col("hi").alias("lo")), "lo", "left_semi").select("hi"))
        if open_nodes.isEmpty():
            break
        now = after
    return after.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        after.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
