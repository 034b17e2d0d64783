"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, settled


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; a component's name is its smallest node.

    Each round hangs every node under its smallest neighbour, shortens the chains and contracts the graph; contracted
    edges and the map of nodes are written out, so lineage stays short, and the tables of the round before are removed.
    Rounds grow with the logarithm of the diameter.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v")
    e = settled(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    nodes = e.select("u").union(e.select("v")).distinct().select(F.col("u").alias("node"))
    found, before = nodes.withColumn("component", F.col("node")), None
    while not e.isEmpty():
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = settled(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("p")), "near")
        up = near
        for _ in range(2):
            over = up.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            up = up.join(over, "p", "left").select("u", F.coalesce("pp", "p").alias("p"))
        up = settled(up, "up")
        left, right = up.select("u", F.col("p").alias("x")), up.select(F.col("u").alias("v"), F.col("p").alias("y"))
        moved = e.join(left, "u").join(right, "v").where("x != y")
        fewer = settled(moved.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "edges")
        mapped = found.join(up.select(F.col("u").alias("component"), "p"), "component", "left")
        found = settled(mapped.select("node", F.coalesce("p", "component").alias("component")), "components")
        forget(near, up, e, before)
        e, before = fewer, found
    return found
