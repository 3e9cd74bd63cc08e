"""Windows, deduplication, sessions, trends and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _first(df: DataFrame, keys: list, order: list) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def dedupe_first(df: DataFrame, key: str | Column, order: list) -> DataFrame:
    """The first row of each key in the given order."""
    return _first(df, [key], order)


def keep_richest(df: DataFrame, fingerprint: Column, fields: Column, when: str, id_col: str) -> DataFrame:
    """Of each fingerprint the row with most fields, then the latest, then the smallest id."""
    return _first(df, [fingerprint], [fields.desc(), F.desc(when), F.col(id_col)])


def best_by_url(df: DataFrame, url: str, score: str, id_col: str) -> DataFrame:
    """One row for each URL: the best score, then the smallest id."""
    return _first(df, [url], [F.desc(score), F.col(id_col)])


def cap_per_group(df: DataFrame, key: str, n: int, order: list) -> DataFrame:
    """The first n rows of each group in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def snapshot_delta(df: DataFrame, source: str, ts: str, value: str, tie: str) -> DataFrame:
    """The change of a value since the source's previous snapshot."""
    return df.withColumn("delta", F.col(value) - F.lag(value).over(Window.partitionBy(source).orderBy(ts, tie)))


def jump_anomalies(df: DataFrame, source: str, ts: str, value: str, tie: str, share: float = 0.10) -> DataFrame:
    """Snapshots whose value differs from the previous one, if above 0, by more than a share of it."""
    prev = F.lag(value).over(Window.partitionBy(source).orderBy(ts, tie))
    return df.withColumn("previous", prev).where("previous > 0").withColumn("jump", F.abs(F.col(value) - F.col("previous")) / F.col("previous")).where(F.col("jump") > share)


def trend(df: DataFrame, source: str, ts: str, value: str, tie: str, n: int) -> DataFrame:
    """``source, first, last, change, mean`` over each source's last n snapshots."""
    last = cap_per_group(df, source, n, [F.desc(ts), F.desc(tie)])
    key = F.struct(ts, tie)
    out = last.groupBy(source).agg(F.min_by(value, key).alias("first"), F.max_by(value, key).alias("last"), F.round(F.avg(value), 6).alias("mean"))
    return out.withColumn("change", F.round(F.col("last") - F.col("first"), 6))


def sessionize(df: DataFrame, key: str, ts: str, tie: str, minutes: int = 60) -> DataFrame:
    """``key, session, first_ts, last_ts, events``: a longer pause than ``minutes`` starts a session."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(F.col(ts).cast("timestamp")).over(w)) > minutes * 60_000_000
    rows = df.withColumn("new", F.coalesce(gap.cast("int"), F.lit(0))).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "session").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("events"))


def merge_topk(hits: DataFrame, query: str, k: int, letters: int = 200) -> DataFrame:
    """The k best hits of each query; of contents that begin alike the best one."""
    print_ = F.left(F.coalesce("content", F.lit("")), F.lit(letters))
    one = _first(hits, [query, print_], [F.desc("score"), F.col("id")])
    return cap_per_group(one, query, k, [F.desc("score"), F.col("id")])


def merge_by_distance(hits: DataFrame, query: str, k: int) -> DataFrame:
    """The k nearest hits of each query, equal contents included."""
    return cap_per_group(hits, query, k, [F.col("distance"), F.col("id")])


def by_priority(urls: DataFrame) -> DataFrame:
    """URLs by sitemap priority, 0.5 if none, the highest first."""
    return urls.orderBy(F.desc(F.coalesce("priority", F.lit(0.5))), "url")


def sample_metadata(df: DataFrame, collection: str, n: int, collections: int, seed: int = 0) -> DataFrame:
    """About n rows, as many of each collection: those with the smallest digests of seed and row.

    The digest is that of the columns as text, joined by ``|`` without nulls. Ranks are limited in every task before rows
    are shuffled, so a large collection sends no more of them than a small one.
    """
    most = max(1, n // max(1, collections))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(f"`{c}`").cast("string") for c in df.columns)))
    return cap_per_group(df, collection, most, [digest])


def last_sessions(events: DataFrame, session: str, ts: str, n: int) -> DataFrame:
    """The n sessions that arrived last."""
    return events.groupBy(session).agg(F.min(ts).alias("first_ts")).orderBy(F.desc("first_ts"), session).limit(n)
