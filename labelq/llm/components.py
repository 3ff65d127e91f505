"""Connected components of a stored edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelq.session import materialised


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the smallest node it sees."""
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
    least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
    return both.where("u > v").join(least, "v").where("u <> m").select(F.col("m").alias("a"), F.col("u").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands itself and its smaller neighbours to the smallest of these."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b")
    pairs = moved.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(moved.select(F.col("m").alias("a"), "b"))
    return pairs.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of ``edges`` (a, b): the smallest node of its component.

    Rounds are written to the shared folder; their number grows with the logarithm of the longest chain. Only a
    count and a checksum of each round reach the driver. A round is written in as many files as the edges need: neither
    kind of step makes more edges than there were.
    """
    one_way = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    now, seen = materialised(one_way, "edges"), None
    n = now.count()
    while True:
        now = materialised(_small_star(_large_star(now)), "edges", n)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("id"), F.col("a").alias("component"))).distinct()
