"""Upserts, merges, purges and incremental scans of tables and property graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def changed_files(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """``path, change``: added, modified or deleted by the hash of ``path, content``."""
    digest = lambda df, name: df.select("path", F.sha2(F.coalesce("content", F.lit("")), 256).alias(name))
    x = digest(current, "new").join(digest(baseline, "old"), "path", "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("new") != F.col("old"), "modified")
    return x.select("path", change.alias("change")).where("change is not null")


def upsert_documents(target: DataFrame, updates: DataFrame, key: str = "doc_id", order: str | None = None) -> DataFrame:
    """``target`` with the rows of ``updates`` in place of those with the same key; of several the last by ``order``."""
    if order:
        updates = updates.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
    return target.join(updates.select(key), key, "left_anti").select(target.columns).unionByName(updates.select(target.columns))


def merge_nodes(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: of every property the last value that is not null."""
    props = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(*(F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in props))


def merge_edges(edges: DataFrame, targets: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """``src, dst, rel, n``: distinct edges whose ends both exist, with how many rows they had."""
    sources = targets if sources is None else sources
    # counted where the first join has dealt the edges by their source: no shuffle of its own
    e = edges.join(sources.select(F.col("node_id").alias("src")).distinct(), "src", "left_semi")
    e = e.groupBy("src", "dst", "rel").agg(F.count("*").alias("n"))
    return e.join(targets.select(F.col("node_id").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst", "rel", "n")


def complete_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node_id, is_placeholder``: the nodes, and one placeholder for each edge end that is none."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct().join(nodes, "node_id", "left_anti")
    return nodes.select("node_id", F.lit(False).alias("is_placeholder")).union(ends.select("node_id", F.lit(True)))


def purge(nodes: DataFrame, edges: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes without those of the predicate, edges without their incident ones, and how many nodes
    of each label go (the dry run)."""
    gone = nodes.where(predicate).select("node_id")
    kept = edges.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti").select("src", "dst", "rel")
    return nodes.where(~F.coalesce(predicate, F.lit(False))), kept, nodes.where(predicate).groupBy("label").agg(F.count("*").alias("n"))


def pending_files(files: DataFrame, done: DataFrame, key: str = "path") -> DataFrame:
    """Files that are not marked as done."""
    return files.join(done.select(key), key, "left_anti")


def merge_duplicate_nodes(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes merged by (label, name) into the one of highest degree, and the edges moved to it.

    Null properties of the keeper are filled from its duplicates; edges become distinct.
    """
    deg = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("degree"))
    n = nodes.join(deg, "node_id", "left").fillna(0, ["degree"])
    best = n.groupBy("label", "name").agg(F.min(F.struct((-F.col("degree")).alias("d"), F.col("node_id").alias("k"))).alias("b")).select("label", "name", F.col("b.k").alias("keeper"))
    placed = n.join(best, ["label", "name"])
    props = [c for c in nodes.columns if c not in ("node_id", "label", "name")]
    merged = placed.groupBy("keeper", "label", "name").agg(*(F.coalesce(F.max(F.when(F.col("node_id") == F.col("keeper"), F.col(c))), F.min(c)).alias(c) for c in props), F.count("*").alias("merged"))
    move = placed.select("node_id", "keeper")
    e = edges.join(move.toDF("src", "a"), "src", "left").join(move.toDF("dst", "b"), "dst", "left")
    return merged.withColumnRenamed("keeper", "node_id"), e.select(F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst"), "rel").distinct()
