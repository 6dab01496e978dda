"""Connected components of links between long ids, as joins and aggregations with written rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import stash


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for each node of a link the smallest node that it reaches.

    Alternating large-star and small-star rounds: each node hooks its larger neighbours, then its
    smaller ones, to the smallest neighbour, until nothing changes. A round is two aggregations by node;
    the number of rounds grows with the logarithm of the longest chain. No component is gathered.
    """
    edges = stash(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "links")
    before = None
    while True:
        # Large star: the neighbours above a node go to the least of its neighbourhood.
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stash(large.filter("u <> v").distinct(), "large-star")
        # Small star: the neighbours below a node, and the node, go to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m")))
        edges = stash(small.filter("u <> v").distinct(), "small-star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        before = now
