"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohesion.llm._store import save


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u moves to the smallest of u and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of u, and u, move to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, component) for each node of ``edges(a, b)`` that isn't the smallest of its component.

    ``component`` is the smallest node that can be reached.  Each round is
    written to the shared folder, and only its row count and two sums come to
    the driver.  Self links and repeated links are ignored.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs, before = save(pairs, name), None
    for _ in range(rounds):
        pairs = save(_small_star(_large_star(pairs).distinct()).distinct(), name)
        now = pairs.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b").bitwiseAND(0xFFFFFFFF))).first()
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
