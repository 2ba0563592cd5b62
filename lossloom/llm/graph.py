"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossloom.llm.common import stage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (the smallest node it reaches) of every node that has an edge; node numbers are longs.

    Loops, repeated edges, either direction and nulls (dropped) are fine. Each round hangs larger neighbours, then smaller
    ones, on the smallest neighbour, until every component is a star; rounds are about the logarithm of the longest path.
    Each round is a table in the shared folder; minima are aggregated before they are shuffled.
    """
    now = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()
    now = stage(now, "edges")
    before = None
    while (mark := _mark(now)) != before:
        before = mark
        now = stage(_small_star(_large_star(now)), "edges")
    leaves = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return leaves.union(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()[:]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("b").agg(F.min("a").alias("m"))
    others = edges.join(low, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return others.union(low.select(F.col("m").alias("a"), "b")).distinct()
