"""Connected components of an edge table by alternating large and small stars.

The edges stay distributed; each round is cut into the shared checkpoint folder.
The number of rounds grows with the logarithm of the longest path.  The least neighbours
are aggregated before the shuffle; as long as their counted number is small they are broadcast, so
that a hub's edges stay where they are, and beyond it adaptive execution splits the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_or_not


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _large(edges: DataFrame, n: int) -> DataFrame:
    """Each node's larger neighbours are linked to the least of its neighbourhood."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(small_or_not(least, 2 * n, 32), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame, n: int) -> DataFrame:
    """Each node's smaller neighbours, and itself, are linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(small_or_not(least, 2 * n, 32), "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges of integer nodes -> (node, root), root the least node of the component; only nodes with an edge."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    while state[0]:
        now = cut(_small(_large(now, state[0]), 2 * state[0]).where("a <> b").distinct())
        state, before = _state(now), state
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
