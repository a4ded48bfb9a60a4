"""Connected components by alternating star contraction, wholly on Spark.

Each half round replaces a node's edges by edges to the least node it sees: first for its larger
neighbours, then for its smaller ones.  Minima are partial aggregates and the rest is a join that
adaptive execution can split, so a node with a third of all edges is no single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.staging import stage


def _settled(edges: DataFrame) -> bool:
    """Whether all edges (u, v) lead straight to roots: no node has two edges or is both ends of edges."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        edges.select(F.col("v").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("n").agg(F.sum("out").alias("o"), F.sum("into").alias("i")).filter("o > 1 OR (o > 0 AND i > 0)").isEmpty()


def _to_least(pairs: DataFrame, keep: str) -> DataFrame:
    """pairs (n, v): edges from the neighbours that ``keep`` selects, and from n, to n's least neighbour."""
    least = pairs.groupBy("n").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "n"))
    out = pairs.join(least, "n")
    spread = out.filter(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select(F.col("n").alias("u"), F.col("m").alias("v"))
    return spread.unionByName(own).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); the component is its least node."""
    step = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    step = stage(step, "edges")
    while not _settled(step):
        both = step.select(F.col("u").alias("n"), "v").unionByName(step.select(F.col("v").alias("n"), F.col("u").alias("v")))
        large = _to_least(both, "v > n")
        small = _to_least(large.select(F.greatest("u", "v").alias("n"), F.least("u", "v").alias("v")), "v < n")
        step = stage(small, "edges")
    return step.select(F.col("u").alias("node"), F.col("v").alias("component"))
