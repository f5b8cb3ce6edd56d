"""Connected components of links, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payrisk.llm.common import store


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for all nodes of ``links``; a component is its least node. Loops and repeated links do no harm.

    Each round hangs the larger neighbours of a node on its least neighbour, then the smaller ones: links stay as
    many at most, and the number of rounds grows with the logarithm of the size. A round's
    links are written, so nothing is computed again if an executor goes.
    """
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u") != F.col("v"))
    edges = store(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    nodes = edges.select(F.col("u").alias("node")).union(edges.select(F.col("v"))).distinct()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        larger = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Larger neighbours now hang on a least one; the node itself hangs there through its smaller neighbours.
        starred = store(larger.union(least.where("m < u").select("u", "m")).where("u != v").distinct(), "links")
        least = starred.groupBy("u").agg(F.min("v").alias("m"))
        smaller = starred.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        settled = smaller.union(least).where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        new = store(settled.distinct(), "links")
        # Done when every node hangs on one node that hangs on none.
        ups, inner = new.groupBy("u").count(), new.select(F.col("v").alias("u")).distinct()
        if ups.where("count > 1").isEmpty() and new.join(inner, "u", "left_semi").isEmpty():
            edges = new
            break
        edges = new
    return nodes.join(edges, nodes["node"] == edges["u"], "left").select(
        "node", F.coalesce("v", "node").alias("component")
    )
