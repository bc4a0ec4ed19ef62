"""Connected components of a sparse graph by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlsight.llm.stored import stored

MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; the root is the component's least node.

    Each round links every node's larger neighbours to its least neighbour and then every
    node and its smaller neighbours to the least of them. Distances shrink by a constant
    factor, so the rounds grow with the logarithm of the longest chain. The least neighbour
    is a combined minimum; it returns to the links by a join whose sides are both stored, so
    that adaptive execution can split the links of a hub.
    """
    links = stored(edges.select(F.least("a", "b").alias("hi"), F.greatest("a", "b").alias("lo"))
                   .select(F.col("lo").alias("a"), F.col("hi").alias("b"))
                   .filter("a > b").distinct())
    before = None
    for _ in range(MOST_ROUNDS):
        links = _small_star(_large_star(links))
        state = tuple(links.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.hash("a", "b").cast("long"))
        ).first())
        if state == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = state
    raise RuntimeError(f"components need more than {MOST_ROUNDS} rounds")


def _least(pairs: DataFrame) -> DataFrame:
    return stored(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of ``u`` is linked to the least of ``u`` and its neighbours."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    larger = links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    moved = larger.join(_least(both), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return stored(moved.filter("a > b").distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """``u`` and its smaller neighbours are linked to the least of them."""
    smaller = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = _least(smaller)
    moved = smaller.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
    return stored(moved.unionByName(own).filter("a > b").distinct())
