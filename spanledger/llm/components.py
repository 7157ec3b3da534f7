"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.llm.rows import stored


def _stars(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step over links with u > v."""
    both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.where("u > v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """node and component (its smallest member) of every node that has a link.

    Nodes may be of any type that can be ordered.
    Rounds grow with the logarithm of the longest path; each is written to the shared
    folder. Links of a node with itself and repeated links change nothing.
    """
    edges = links.select(
        F.greatest(left, right).alias("u"), F.least(left, right).alias("v")
    ).where("u > v")
    edges, seen = stored(edges.distinct(), "links"), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
        edges = stored(_stars(edges), "links")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        roots.select("node", F.col("node").alias("component"))
    )
