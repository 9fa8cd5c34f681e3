"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.llm.store import written


def _both(e: DataFrame) -> DataFrame:
    return e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large(e: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of the node and its neighbours."""
    both = _both(e)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()


def _small(e: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them. a > b in every link."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).where("a > b").distinct()


def _stars(e: DataFrame) -> bool:
    """Whether every link leads to a centre, from a node that no other link has: each star is a whole component then."""
    ends = e.select(F.col("a").alias("node"), F.lit(1).alias("out")).unionAll(e.select(F.col("b").alias("node"), F.lit(0).alias("out")))
    return ends.groupBy("node").agg(F.sum("out").alias("links"), F.min("out").alias("least")).where("links > 1 OR (links = 1 AND least = 0)").isEmpty()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """node, component (least node reachable) of every node in links (columns a and b, longs); a node alone is left out.

    Each round keeps a table of at most as many links, in the shared folder; nothing is collected but whether all links form
    stars, which ends the rounds. Their number grows with the logarithm of the longest path.
    """
    e = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = written(_small(_large(e)), name)
    while not _stars(e):
        e = written(_small(_large(e)), name)
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
