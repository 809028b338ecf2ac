"""Connected components of an edge list, by alternating large-star and small-star steps on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written


def star_components(edges: DataFrame) -> DataFrame:
    """edges (a, b: long) -> (node, root): every node that has a link but is not its component's smallest, with that smallest.

    Each step is a partial aggregate and an equi-join, so a hub is pre-aggregated before the shuffle and its join
    side can be split. Loops and repeated links have no effect; nulls are ignored. Empty in, empty out.
    """
    links = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = written(links, "links")
    seen = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state[0] == 0 or state == seen:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = written(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "links")
