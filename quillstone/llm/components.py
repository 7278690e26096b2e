"""Connected components of a large graph by alternating stars, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.base import cut, drop_cut


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def stars(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(a, b) of bigint -> (a, b): every node but the least of a component, with that least node.

    Each round links larger neighbours, then smaller ones, to the least neighbour;
    the edges never grow in number and the rounds grow as the logarithm of the
    longest path. The least neighbours are written first, so that both sides of the
    joins are plain exchanges, which Spark splits when one node has very many edges.
    Loops and repeated edges are left out.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(max_rounds):
        if not mark[0]:
            return now
        files = max(8, mark[0] // 100_000)
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least", files)
        large = cut(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large", files)
        lower = cut(large.groupBy("a").agg(F.min("b").alias("m")), "lower", files)
        small = large.join(lower, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lower.select("a", F.col("m").alias("b"))).distinct()
        after = cut(small, "edges", files)
        marked = _mark(after)
        for old in (now, least, large, lower):
            drop_cut(old)
        now = after
        if marked == mark:
            return now
        mark = marked
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
