"""Set operations and comparisons of result sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_names(*dfs: DataFrame) -> DataFrame:
    """Distinct values of the tables' only column."""
    return reduce(DataFrame.union, dfs).distinct()


def compare_results(a: DataFrame, b: DataFrame, mode: str = "set", tol: float = 0.10) -> DataFrame:
    """Rows that differ. set: (id, side) of ids on one side; ordered: ranks (``rank, id``) whose ids
    differ; numeric: keys (``key, value``) apart by more than ``tol`` of the first."""
    if mode == "set":
        return a.exceptAll(b).withColumn("side", F.lit("left")).union(b.exceptAll(a).withColumn("side", F.lit("right")))
    if mode == "ordered":
        x = a.select("rank", F.col("id").alias("left_id")).join(b.select("rank", F.col("id").alias("right_id")), "rank", "full")
        return x.where("not (left_id <=> right_id)")
    x = a.select("key", F.col("value").alias("left_value")).join(b.select("key", F.col("value").alias("right_value")), "key", "full")
    far = F.abs(F.col("left_value") - F.col("right_value")) > tol * F.abs("left_value")
    return x.where(F.coalesce(far, F.lit(True)))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays as sets; two empty ones overlap fully."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node_id`` of the nodes without an edge."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id"))
    return nodes.select("node_id").join(ends, "node_id", "left_anti")
