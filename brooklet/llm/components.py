"""Connected components of a distributed graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brooklet.llm.common import land


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); the label is the smallest node of the component.

    Large star: every node's larger neighbours are tied to its smallest
    neighbour.  Small star: its smaller neighbours and itself are.  Both only
    take minima per node, which Spark combines before the shuffle.  The edges
    end as stars around the smallest nodes.  Only a count and a checksum per
    round come to the driver.
    """
    edges = land(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(least, "a")
        small = tied.select("a", F.col("m").alias("b")).unionByName(tied.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = land(small.distinct())
        n, total = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, total) == before:
            break
        before = (n, total)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )
