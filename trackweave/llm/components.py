"""Connected components of a links table, by alternating stars with written rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm.scratch import stored


def _digest(edges: DataFrame) -> tuple[int, int]:
    n, s = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1)))).first()
    return n, s or 0


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """The least node of each node's component: ``node``, ``component``; nodes without links are absent.

    ``edges`` has columns ``a`` and ``b``. Each round moves neighbours to their least neighbour;
    aggregates and joins only, so that a node with very many links stays in parts. With ``rounds``
    it stops after so many, and nodes of one component may still have several labels.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    if rounds:
        for _ in range(rounds):
            edges = stored(_small_star(_large_star(edges)), "links")
    else:
        edges = stored(edges, "links")
        before = _digest(edges)
        while before[0]:
            edges = stored(_small_star(_large_star(edges)), "links")
            after = _digest(edges)
            if after == before:
                break
            before = after
    roots = edges.select(F.col("b").alias("node")).distinct()
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
    return labels.groupBy("node").agg(F.min("component").alias("component"))
