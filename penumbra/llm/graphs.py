"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penumbra.llm.shared import settle


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes in ``links`` (columns u and v); the component is its least node.

    Large-star and small-star rounds in turn: every node links its neighbours to
    the least of them until only stars around the least nodes are left. The
    number of rounds grows as the logarithm of the size of the components.
    Links stay in tables; only a count and a checksum reach the driver.
    """
    edges = settle(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select(F.col("u").alias("node"), F.least("u", "w").alias("m"))
        # from each node to the least around it, from those of its neighbours that are larger
        large = both.filter("v > u").join(least, F.col("u") == F.col("node")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large.unionByName(least.select(F.col("node").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), "m")
        small = large.join(lowest, F.col("u") == F.col("node")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = settle(small.unionByName(lowest.select(F.col("node").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct(), "links")
        after = _state(edges)
        if after == state:
            break
        state = after
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
