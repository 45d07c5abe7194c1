"""Connected components of a table of links, by alternating large-star and small-star steps (Kiveris and others, 2014).

All steps are joins and grouped minima of (a, b) rows. Minima are written before they are joined, a row a node: they
are broadcast while they are few, and beyond that both sides of the join are plain shuffles, in which Spark splits the
rows of a hub. A step's result is written to the shared folder, so lineage stays short; the driver sees counts only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import join_small, materialise


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``links`` has a and b (longs, not null); returns node and component, its smallest reachable node.

    Nodes of no link don't occur. Repeated, reversed and self links are fine. No links: no rows.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialise(edges, "edges")
    for _ in range(rounds):
        # large star: all larger neighbours of a node move to its smallest one
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
        if least.filter("m < a AND n > 1").isEmpty():  # all nodes but the smallest of each component hang on that one alone
            break
        large = join_small(both, least.drop("n"), ["a"], "inner").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = materialise(large, "large")
        # small star: all smaller neighbours of a node, and itself, move to the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = join_small(large, materialise(least, "least"), ["a"], "inner").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        edges = materialise(small, "edges")
    else:
        raise RuntimeError("components have not settled")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
