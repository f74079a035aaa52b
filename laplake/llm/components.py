"""Connected components of an edge table, as repeated Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laplake.llm.frames import staged


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); a component is its smallest node.

    Large-star and small-star steps in turn until nothing changes: each node
    hands its smallest neighbour to the others, so chains halve and every
    component ends as a star around its smallest node. Each round is written to
    the shared folder. Loops and repeated edges do no harm.
    """
    edges = edges.where(F.col("a") != F.col("b")).select("a", "b")
    state = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low")).withColumnRenamed("a", "n")
        large = both.join(low, both["a"] == low["n"]).where(F.col("b") > F.col("a")).select(
            F.col("b").alias("a"), F.col("low").alias("b")).where(F.col("a") != F.col("b")).distinct()
        # Now every edge points from the larger node to the smaller.
        low = large.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "n")
        joined = large.join(low, large["a"] == low["n"])
        small = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).union(
            joined.select("a", F.col("low").alias("b"))).where(F.col("a") != F.col("b")).distinct()
        edges = staged(small, "stars")
        seen = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == state:
            break
        state = seen
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
