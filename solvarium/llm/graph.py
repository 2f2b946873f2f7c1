"""Connected components by alternating large and small stars, on narrow tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvarium.llm._shared import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) for every node of `edges` (a, b): label is the least node of its component.

    A step points a node's neighbours at the least one around it; steps alternate between greater and smaller
    neighbours and halve what is left, so their number grows as the logarithm of the longest path. Least neighbours
    are combined before the shuffle and written, so that the join that follows reads two plain exchanges, of which
    Spark can split a node with very many edges.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, said, k = scratch.save(now, f"{name}0"), None, 0
    while (sign := _signature(now)) != said:
        said, before = sign, k
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.save(both.groupBy("a").agg(F.min("b").alias("m")), f"{name}{k}-large")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        now = scratch.save(large.distinct(), f"{name}{k + 1}")
        least = scratch.save(now.groupBy("a").agg(F.min("b").alias("m")), f"{name}{k + 1}-small")
        small = now.join(least, "a")
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = scratch.save(small.select("e.*").where("a <> b").distinct(), f"{name}{k + 2}")
        k += 2
        scratch.drop(f"{name}{before}", f"{name}{before}-large", f"{name}{before + 1}", f"{name}{before + 1}-small")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots.select("node", F.col("node").alias("label")))


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
