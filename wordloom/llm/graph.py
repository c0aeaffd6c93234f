"""Connected components of an undirected graph whose nodes are 64-bit integers, in Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import salted_join, stored


def components(links: DataFrame) -> DataFrame:
    """links(a, b) to (node, root): root is the smallest node that can be reached; nodes without links are absent.

    Large-star and small-star steps in turn: each replaces links by links to the smallest neighbour, so that paths
    halve in a round, and joins deal the neighbours of a node with many over several tasks. Every round is written to the shared folder.
    """
    links = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"), F.sum((F.col("b") > F.col("a")).cast("long")).alias("n")), "low")
        # large star: larger neighbours of a node go to the smallest node of its neighbourhood
        upward = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
        large = stored(salted_join(upward, low, "a", "n").select(F.col("b").alias("a"), F.col("root").alias("b")).filter("a <> b").distinct(), "large")
        # small star: a node and its smaller neighbours go to the smallest of these
        down = stored(large.groupBy("a").agg(F.min("b").alias("root"), F.count("*").alias("n")), "down")
        small = salted_join(large, down, "a", "n").select(F.col("b").alias("a"), F.col("root").alias("b"))
        links = stored(small.unionByName(down.select("a", F.col("root").alias("b"))).filter("a <> b").distinct(), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(now) == state:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = tuple(now)
