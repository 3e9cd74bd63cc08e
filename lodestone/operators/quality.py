"""Integrity, coverage and drift reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import cosine


def gap_report(sources: DataFrame, counts: DataFrame, now: str, stale_days: int = 30, gap: float = 0.90) -> DataFrame:
    """``collection, declared, actual, coverage, status``: status is the first of gap, missing, stale, healthy.

    ``sources``: name, collection, enabled, doc_count, last_ingested. Coverage is 1 where
    nothing is declared.
    """
    s = sources.where("enabled").groupBy("collection").agg(F.sum("doc_count").alias("declared"), F.max("last_ingested").alias("last"), F.sum(F.col("last_ingested").isNull().cast("int")).alias("never"))
    x = s.join(counts.select("collection", F.col("n").alias("actual")), "collection", "left").fillna(0, ["actual"])
    x = x.withColumn("coverage", F.round(F.when(F.col("declared") == 0, 1.0).otherwise(F.col("actual") / F.col("declared")), 6))
    old = F.col("last") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(stale_days)} DAYS")
    status = F.when(F.col("coverage") < gap, "gap").when(F.col("never") > 0, "missing").when(old, "stale").otherwise("healthy")
    return x.select("collection", "declared", "actual", "coverage", status.alias("status"))


def path_consistency(chunks: DataFrame, prefixes: list[str], path: str = "path") -> DataFrame:
    """One row: paths, absolute ones, and ones that begin with a checkout's prefix."""
    p = F.col(path)
    bad = F.exists(F.array(*map(F.lit, prefixes)), lambda x: p.startswith(x))
    return chunks.agg(F.count("*").alias("n"), F.count_if(p.startswith("/")).alias("absolute"), F.count_if(bad).alias("prefixed"))


def stale_share(chunks: DataFrame, times: DataFrame, now: str, days: int = 30, most: float = 0.25) -> DataFrame:
    """One row ``n, stale, share, passes``: older than the source's time, or than ``days`` where it has none."""
    x = chunks.where("updated is not null").join(times.select("source", "source_time"), "source", "left")
    old = F.when(F.col("source_time").isNotNull(), F.col("updated") < F.col("source_time")).otherwise(F.datediff(F.lit(now).cast("timestamp"), "updated") > days)
    x = x.agg(F.count("*").alias("n"), F.count_if(old).alias("stale"))
    return x.withColumn("share", F.round(F.coalesce(F.col("stale") / F.nullif("n", F.lit(0)), F.lit(0.0)), 6)).withColumn("passes", F.col("share") < most)


def coverage(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """``language, files, nodes, status``: OK from 0.9 nodes a file, WARN from 0.5, else FAIL; without files
    OK above 100 nodes, else WARN."""
    f = files.groupBy("language").agg(F.count("*").alias("files"))
    n = nodes.groupBy("language").agg(F.count("*").alias("nodes"))
    x = f.join(n, "language", "full").fillna(0, ["files", "nodes"])
    r = F.col("nodes") / F.nullif("files", F.lit(0))
    status = F.when((F.col("files") == 0) & (F.col("nodes") > 100), "OK").when(F.col("files") == 0, "WARN").when(r >= 0.9, "OK").when(r >= 0.5, "WARN").otherwise("FAIL")
    return x.withColumn("status", status)


def embedding_drift(stored: DataFrame, fresh: DataFrame, key: str, least: float = 0.95) -> DataFrame:
    """One row ``n, mean, lowest, drifted`` of the cosine of stored and fresh vectors."""
    x = stored.select(key, F.col("vector").alias("a")).join(fresh.select(key, F.col("vector").alias("b")), key).withColumn("c", cosine(F.col("a"), F.col("b")))
    return x.agg(F.count("*").alias("n"), F.round(F.avg("c"), 6).alias("mean"), F.round(F.min("c"), 6).alias("lowest"), F.count_if(F.col("c") < least).alias("drifted"))


def steady_mean(value: Column, kind: str = "decimal(28,10)") -> Column:
    """The mean of doubles that are short decimals, summed as decimals, so that it does not depend on the order of rows.

    A group with a value that ``kind`` does not hold exactly has the mean of its doubles.
    """
    short = value.try_cast(kind)
    short = F.when(short.cast("double") == value, short)
    return F.when(F.count(short) == F.count(value), F.avg(short).cast("double")).otherwise(F.avg(value))


def range_drift(metrics: DataFrame, ranges: DataFrame) -> DataFrame:
    """Metrics outside their range (``metric, low, high``)."""
    return metrics.join(ranges, "metric").where("value < low or value > high").select("metric", "value", "low", "high")


def health(indices: Column, nodes: Column, least: int = 5) -> Column:
    """healthy with enough indices and nodes, degraded with only one of both, else unhealthy."""
    a, b = indices >= least, nodes > 0
    return F.when(a & b, "healthy").when(a | b, "degraded").otherwise("unhealthy")


def run_report(facts: DataFrame) -> DataFrame:
    """``tenant, branch, mode, files, facts, errors`` of an ingestion's facts."""
    return facts.groupBy("tenant", "branch", "mode").agg(F.countDistinct("path").alias("files"), F.count_if(F.col("error").isNull()).alias("facts"), F.count_if(F.col("error").isNotNull()).alias("errors"))
