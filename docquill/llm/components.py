"""Connected components of a graph that no single task holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquill.scratch import materialize


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of all nodes in ``links`` (a, b): component is the smallest node that can be reached.

    Alternates large-star and small-star steps (Kiveris and others, 2014), which
    need a number of rounds that grows with the logarithm of the longest path.
    Minima are aggregated in each task before the shuffle; the table of minima
    is written, so that the join that follows can split a hot node's links.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = materialize(edges, "links")
    for _ in range(most_rounds):
        # large star: link each larger neighbour to the least one
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # every node keeps a link to its least neighbour
        large = materialize(large, "large-star")
        # small star: link the node and its smaller neighbours to the least of them
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        small = materialize(small, "small-star")
        # stars only: no centre has a smaller neighbour of its own
        centres = small.select(F.col("v").alias("u")).distinct()
        edges = small
        if small.groupBy("u").count().where("count > 1").isEmpty() and small.join(centres, "u", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError(f"components are not stable after {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
