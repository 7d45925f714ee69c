"""Connected components of links as Spark joins: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyspark.session import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (or not larger) neighbours of each node, with the node itself, on its least neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).select(F.col("a").alias("n"), "m")
    joined = both.join(least, F.col("a") == F.col("n"))
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) of every node with a link to another: component is the least node it reaches.

    A node of many links costs no more than its links: minima combine before they are shuffled. Steps go on until
    the edges stay the same, each written to the shared folder. Links with a null end count for nothing.
    """
    edges = written(links.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).where(f"{left} IS NOT NULL AND {right} IS NOT NULL").where("a <> b").distinct(), "links")
    state = None
    while True:
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        state = seen
        edges = written(_star(_star(edges, True), False), "links")
