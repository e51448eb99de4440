"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame, work, *, most_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of `edges` (columns a, b): the smallest node that it can reach.

    Every round writes its edges, and ends when the set of edges no longer changes. A node with very many
    neighbours is reduced by a partial minimum before its rows meet.
    """
    now = work.keep(_ordered(edges), "edges")
    sign = _sign(now)
    for _ in range(most_rounds):
        after = work.keep(_small_star(_large_star(now)), "edges")
        new = _sign(after)
        work.drop(now)
        now = after
        if new == sign:
            break
        sign = new
    else:
        raise RuntimeError("components did not settle")
    labels = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()


def _ordered(edges: DataFrame) -> DataFrame:
    """Each edge once, its larger end as a."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node go to the smallest of its neighbourhood."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return _ordered(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and the node, go to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _ordered(moved.unionByName(least.select("a", F.col("m").alias("b"))))
