"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.scratch import Scratch


def _star(directed: DataFrame, keep) -> DataFrame:
    """For each u the smallest of u and its neighbours v; (v, that) for the kept v, as (big, small)."""
    least = directed.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
    return directed.join(least, "u").where(keep).select(F.col("v").alias("big"), F.col("least").alias("small")), least


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b: long), root the smallest node reachable.

    A step needs two hash joins and a few minima, combined before each shuffle; no neighbour list is
    gathered, so a node with very many neighbours is only a skewed join, which Spark splits. Every
    step's edges are written, so nothing is recomputed from the start. Loops and null ends are dropped.
    """
    now = scratch.save(
        edges.where("a <> b").select(F.greatest("a", "b").alias("big"), F.least("a", "b").alias("small")).distinct()
    )
    while not _settled(now):
        both = now.select(F.col("big").alias("u"), F.col("small").alias("v")).union(now.select(F.col("small").alias("u"), F.col("big").alias("v")))
        large, _ = _star(both, F.col("v") > F.col("u"))
        large = scratch.save(large.where("big <> small").distinct())
        down = large.select(F.col("big").alias("u"), F.col("small").alias("v"))
        small, least = _star(down, F.lit(True))
        small = small.union(least.select(F.col("u").alias("big"), F.col("least").alias("small")))
        after = scratch.save(small.where("big <> small").distinct())
        scratch.drop(large)
        scratch.drop(now)
        now = after
    return now.select(F.col("big").alias("node"), F.col("small").alias("root"))


def _settled(edges: DataFrame) -> bool:
    """Whether every node points straight at one root that points nowhere."""
    ends = edges.select(F.col("big").alias("v"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(edges.select("small", F.lit(0), F.lit(1)))
    return ends.groupBy("v").agg(F.sum("out").alias("o"), F.max("in").alias("i")).where("o > 1 or (o > 0 and i > 0)").isEmpty()
