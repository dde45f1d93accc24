"""Connected components by contraction: distributed, and no node's neighbours ever meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that links (a, b) connect each node with; isolated nodes are absent.

    Nodes are put in the order of their hashes, which no shape of a graph follows, and each round merges
    every node into the first one among itself and its neighbours. A node with links has a fair chance to go,
    so a fixed part of them goes each round and rounds grow with the logarithm of the component (a chain of
    500 rising nodes takes less than ten, a star two). Minima combine before their shuffle, so a node with
    a third of all links is one row a task. Self-links and repeated links do no harm; null ends have no link.
    """
    edges = stored(links.select("a", "b").where("a <> b"), "links")
    names = None
    while not edges.isEmpty():
        drawn = F.xxhash64("b")
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(drawn).alias("drawn"), F.min_by("b", drawn).alias("b"))
        here = F.xxhash64("a")
        nearest = stored(first.select(F.col("a").alias("node"), F.when(F.col("drawn") < here, F.col("b")).otherwise(F.col("a")).alias("to")), "nearest")
        if names is None:
            names = nearest.select("node", F.col("to").alias("label"))
        else:
            step = nearest.select(F.col("node").alias("label"), "to")
            names = stored(names.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        one = nearest.select(F.col("node").alias("a"), F.col("to").alias("a2"))
        two = nearest.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        merged = edges.join(one, "a").join(two, "b").where("a2 <> b2")
        edges = stored(merged.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "links")
    if names is None:
        return links.select(F.col("a").alias("node"), F.col("a").alias("label")).limit(0)
    smallest = names.groupBy("label").agg(F.min("node").alias("smallest"))
    return stored(names.join(smallest, "label").select("node", F.col("smallest").alias("label")), "labels")
