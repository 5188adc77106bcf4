"""Components of links, as distributed tables: a hub with any number of links is a skewed join, never a list in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tessel.llm.common import drop, written


def components(links: DataFrame) -> DataFrame:
    """links (a, b: long) -> (id, root): each linked id with the smallest id of its component.

    Rounds of large-star and small-star until no link changes; each is two aggregates and two joins, so a
    hub with any number of links is a skewed join that AQE splits, not a list in one task.
    """
    edges, state = _written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(_distinct(large), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        nxt = small.select("u", F.col("m").alias("v")).unionByName(small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        before, old = state, edges
        edges, state = _written(nxt)
        drop(large)
        drop(old)
        if state == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root"))).distinct()


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").distinct()


def _written(edges: DataFrame) -> tuple[DataFrame, dict]:
    """The distinct edges, written, and a digest of them that the same pass has made."""
    seen = Observation()
    out = written(_distinct(edges).observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "links")
    return out, seen.get
