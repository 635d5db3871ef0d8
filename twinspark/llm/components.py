"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspark.llm.shared import remove, stored


def components(edges: DataFrame, root: str, most_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable), for each node of edges (a long, b long); loops are ignored, repeated
    edges do no harm. Stored in the shared folder `root`.

    Every round joins each edge to the smallest neighbour of its end, so the number of rounds grows with the
    logarithm of the diameter. Only minima are grouped, with partial aggregation, and they are written before the join
    back, so adaptive execution splits a node with very many edges. The minima also tell when all is done, and are the
    result then: edges are stars where a node with a smaller neighbour has no other. The tables of a round are deleted
    when the next one is written."""
    spark = edges.sparkSession
    links = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), f"{root}/links-0")
    most = 2 * links.count()  # about as many nodes, and edges of a round, at most
    for i in range(1, most_rounds + 1):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.min("b").alias("low"), (F.min("b") < F.max("b")).alias("several")).withColumn("low", F.least("low", "a")), f"{root}/low-{i}", most)
        if low.where("several and low < a").isEmpty():
            remove(spark, f"{root}/links-{i - 1}")
            return low.select(F.col("a").alias("node"), F.col("low").alias("component"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        # Every edge of `large` now points from a larger to a smaller node.
        large = stored(large, f"{root}/large-{i}", most)
        least = stored(large.groupBy("a").agg(F.min("b").alias("low")), f"{root}/lower-{i}", most)
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "low"), F.struct(F.col("a").alias("b"), "low"))).alias("x")).select(F.col("x.b").alias("a"), F.col("x.low").alias("b"))
        links = stored(small.where("a <> b").distinct(), f"{root}/links-{i}", most)
        remove(spark, *(f"{root}/{name}" for name in (f"links-{i - 1}", f"low-{i}", f"large-{i}", f"lower-{i}")))
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")


def joined(parts: DataFrame, more: DataFrame, root: str) -> DataFrame:
    """The components of the edges that parts (node, component) comes from and of further ones (a, b; a stored table):
    parts itself if there are none, and no edge but these and a node's to its component is looked at."""
    if more.isEmpty():
        return parts
    return components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), root)
