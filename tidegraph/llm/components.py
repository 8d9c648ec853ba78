"""Connected components of links that stay rows: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..storage import stored


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every end of a link (a, b); the component is its smallest node.

    Each round hangs nodes on the smallest node they know, until nothing changes.
    Rounds grow with the logarithm of the longest chain. Every step is a minimum by
    node and a join with it, so a node with any number of links is never one row.
    Self links give components of one; an empty table gives an empty result.
    """
    nodes = stored(links.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = stored(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "lowest")
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a <> b").distinct(), "large-stars")
        lowest = stored(large.groupBy("a").agg(F.min("b").alias("m")), "lowest")
        small = large.join(lowest, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        edges = stored(small.where("a <> b").distinct(), "edges")
    joined = nodes.join(edges, nodes["node"] == edges["a"], "left")
    return stored(joined.select("node", F.coalesce("b", "node").alias("component")), "components")
