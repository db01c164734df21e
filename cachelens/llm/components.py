"""Connected components of an edge table by repeated contraction, entirely in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node of ``edges`` (a, b) the smallest node that it reaches.

    Each round points every node at its smallest neighbour, follows the pointers twice and contracts the
    edges; at least half of the nodes that still have an edge go. The tables of a round are written to the
    shared folder. A null end or a loop makes no link; repeated edges count once.
    """
    left = stored(
        edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
        .filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    found = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).withColumn("to", F.least("node", "to"))
        up = stored(up, "pointers")  # of known size: a small one is broadcast, so a hub's neighbours stay spread
        for _ in range(2):
            over = up.select(F.col("node").alias("to"), F.col("to").alias("further"))
            up = up.join(over, "to", "left").select("node", F.coalesce("further", "to").alias("to"))
        up = stored(up, "pointers")
        left = stored(
            left.join(up.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
            .join(up.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
            .filter("x <> y")
            .select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
            .distinct(),
            "edges",
        )
        if found is None:
            found = up.select("node", F.col("to").alias("component"))
        else:
            over = up.select(F.col("node").alias("component"), F.col("to").alias("further"))
            found = found.join(over, "component", "left").select("node", F.coalesce("further", "component").alias("component"))
            found = stored(found, "components")
    if found is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found
