"""Counts and statistics over graphs, files, events and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def label_counts(nodes: DataFrame, label: str = "label") -> DataFrame:
    """``label, n``: nodes of each label; labels without nodes have no row."""
    return nodes.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))


def relationship_counts(edges: DataFrame) -> DataFrame:
    """``rel, n``: edges of each relationship."""
    return edges.groupBy("rel").agg(F.count("*").alias("n"))


def graph_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of distinct nodes, edges, labels and relationships."""
    a = nodes.agg(F.countDistinct("node_id").alias("nodes"), F.countDistinct("label").alias("labels"))
    b = edges.agg(F.count("*").alias("edges"), F.countDistinct("rel").alias("rels"))
    return a.withColumn("one", F.lit(1)).join(b.withColumn("one", F.lit(1)), "one").drop("one")


def module_usage(edges: DataFrame, rel: str) -> DataFrame:
    """``dst, importers, names``: distinct sources of each target over one relationship."""
    return edges.where(F.col("rel") == rel).groupBy("dst").agg(F.countDistinct("src").alias("importers"), F.array_join(F.sort_array(F.collect_set("src")), ",").alias("names"))


def complexity(edges: DataFrame) -> DataFrame:
    """``node, fan_in, fan_out, complexity, band``: fan-in times fan-out; over 50 high, over 20 moderate."""
    ends = edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select("dst", F.lit(1), F.lit(0)))
    out = ends.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out")).withColumn("complexity", F.col("fan_in") * F.col("fan_out"))
    return out.withColumn("band", F.when(F.col("complexity") > 50, "high").when(F.col("complexity") > 20, "moderate").otherwise("low"))


def impact_bands(edges: DataFrame, rel: str) -> DataFrame:
    """``dst, dependents, band``: distinct dependents; over 50 HIGH, over 20 MEDIUM, else LOW."""
    out = edges.where(F.col("rel") == rel).groupBy("dst").agg(F.countDistinct("src").alias("dependents"))
    return out.withColumn("band", F.when(F.col("dependents") > 50, "HIGH").when(F.col("dependents") > 20, "MEDIUM").otherwise("LOW"))


def contributions(rows: DataFrame, author: str, component: str) -> DataFrame:
    """``author, component, n``: contributions of each author to each component."""
    return rows.groupBy(F.col(author).alias("author"), F.col(component).alias("component")).agg(F.count("*").alias("n"))


def primary_language(files: DataFrame) -> DataFrame:
    """``repo, language``: the most frequent known language (``repo, language, seq``); ties to the first seen."""
    n = files.where("language is not null").groupBy("repo", "language").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    return n.groupBy("repo").agg(F.max_by("language", F.struct("n", -F.col("first"))).alias("language"))


def lines_of_code(files: DataFrame, repo: str, content: str) -> DataFrame:
    """``repo, lines, files``: lines of all files; null content has none."""
    return files.groupBy(F.col(repo).alias("repo")).agg(F.sum(F.size(F.split(F.coalesce(content, F.lit("")), "\n"))).alias("lines"), F.count("*").alias("files"))


def source_summary(sources: DataFrame) -> DataFrame:
    """``source_type, scope, collection_target, sources, enabled, declared`` by each of the three in one pass."""
    out = sources.groupingSets([["source_type"], ["scope"], ["collection_target"]], "source_type", "scope", "collection_target")
    return out.agg(F.count("*").alias("sources"), F.sum(F.col("enabled").cast("int")).alias("enabled"), F.sum("doc_count").alias("declared"))


def scan_summary(violations: DataFrame, files: int = 20, examples: int = 3) -> DataFrame:
    """``category, issues, files, examples``: issues of each category with its first files and examples.

    Only the rows that are shown are collected: each category's are ranked first.
    """

    def first(column: str, most: int, name: str) -> DataFrame:
        w = Window.partitionBy("category").orderBy(column)
        x = violations.select("category", column).where(F.col(column).isNotNull()).distinct().withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
        return x.groupBy("category").agg(F.sort_array(F.collect_list(column)).alias(name))

    out = violations.groupBy("category").agg(F.count("*").alias("issues"))
    for column, most, name in (("path", files, "files"), ("message", examples, "examples")):
        out = out.join(first(column, most, name), "category", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def community_stats(membership: DataFrame) -> DataFrame:
    """``communities, smallest, largest, mean`` over the sizes of all communities."""
    n = membership.groupBy("community").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("communities"), F.min("n").alias("smallest"), F.max("n").alias("largest"), F.round(F.avg("n"), 1).alias("mean"))


def size_buckets(membership: DataFrame) -> DataFrame:
    """``bucket, communities`` by size: 1, 2-3, 4-10, 11-50, 51-200, 200+."""
    n = membership.groupBy("community").agg(F.count("*").alias("n"))
    bucket = F.when(F.col("n") <= 1, "1").when(F.col("n") <= 3, "2-3").when(F.col("n") <= 10, "4-10").when(F.col("n") <= 50, "11-50").when(F.col("n") <= 200, "51-200").otherwise("200+")
    return n.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("communities"))


def largest_communities(membership: DataFrame, least: int, limit: int) -> DataFrame:
    """``community, n``: the largest communities with at least ``least`` members."""
    n = membership.groupBy("community").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return n.orderBy(F.desc("n"), "community").limit(limit)


def type_breakdown(rows: DataFrame, group: str, kind: str) -> DataFrame:
    """``group, kind, n``: how many rows of each kind a group has."""
    return rows.groupBy(F.col(group).alias("grp"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"))


def hit_rate(results: DataFrame) -> DataFrame:
    """``category, queries, hit_rate`` of ``category, hit``."""
    return results.groupBy("category").agg(F.count("*").alias("queries"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"))


def source_health(chunks: DataFrame, now: str, days: int = 7) -> DataFrame:
    """``source, n, quality, recent, stale_ratio`` of ``source, quality, updated``."""
    fresh = F.col("updated") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    out = chunks.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 2).alias("quality"), F.sum(F.when(fresh, 1).otherwise(0)).alias("recent"))
    return out.withColumn("stale_ratio", F.round(1 - F.col("recent") / F.col("n"), 6))


def quality_buckets(chunks: DataFrame, score: str) -> DataFrame:
    """``bucket, n``: from 0.8 high, from 0.6 medium, from 0.4 low, else very_low."""
    q = F.col(score)
    return chunks.groupBy(F.when(q >= 0.8, "high").when(q >= 0.6, "medium").when(q >= 0.4, "low").otherwise("very_low").alias("bucket")).agg(F.count("*").alias("n"))


def session_analytics(events: DataFrame, done: str, dropped: str) -> DataFrame:
    """``session, status, steps, minutes, last_ts``: completed beats abandoned, else started."""
    out = events.groupBy("session").agg(
        F.max(F.when(F.col("event") == done, 2).when(F.col("event") == dropped, 1).otherwise(0)).alias("s"),
        F.count("*").alias("steps"),
        F.round((F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))) / 60, 4).alias("minutes"),
        F.max("ts").alias("last_ts"),
    )
    return out.select("session", F.when(F.col("s") == 2, "completed").when(F.col("s") == 1, "abandoned").otherwise("started").alias("status"), "steps", "minutes", "last_ts")


def session_summary(sessions: DataFrame, last: int = 10) -> DataFrame:
    """One row of ``completed, abandoned, in_progress, mean_minutes, least_minutes, most_minutes, mean_steps``
    of sessions (``session, status, steps, minutes, last_ts``): minutes are those of completed sessions,
    steps those of the ``last`` sessions to end."""
    of = lambda s: F.count(F.when(F.col("status") == s, 1))
    done = F.when(F.col("status") == "completed", F.col("minutes"))
    counts = sessions.agg(of("completed").alias("completed"), of("abandoned").alias("abandoned"), of("started").alias("in_progress"), F.round(F.avg(done), 4).alias("mean_minutes"), F.min(done).alias("least_minutes"), F.max(done).alias("most_minutes"))
    recent = sessions.orderBy(F.desc("last_ts"), F.desc("session")).limit(last).agg(F.round(F.avg("steps"), 1).alias("mean_steps"))
    return counts.withColumn("one", F.lit(1)).join(recent.withColumn("one", F.lit(1)), "one").drop("one")


def tag_distribution(steps: DataFrame) -> DataFrame:
    """``tag, n, percent`` of steps (``tag``); no tag counts as unknown. Percents are whole, halves go to the even one."""
    n = steps.groupBy(F.coalesce(F.when(F.col("tag") != "", F.col("tag")), F.lit("unknown")).alias("tag")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n")).first()[0] or 0
    return n.withColumn("percent", F.bround(F.col("n") * 100 / F.lit(total)).cast("long"))


def language_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``src_label, rel, dst_label, n``: edges between labels."""
    n = nodes.select("node_id", "label")
    out = edges.join(n.toDF("src", "src_label"), "src").join(n.toDF("dst", "dst_label"), "dst")
    return out.groupBy("src_label", "rel", "dst_label").agg(F.count("*").alias("n"))


def crawl_stats(pages: DataFrame) -> DataFrame:
    """``host, depth, n``: pages of each host and path depth of ``host, path``."""
    depth = F.size(F.filter(F.split("path", "/"), lambda x: x != ""))
    return pages.groupBy("host", depth.alias("depth")).agg(F.count("*").alias("n"))


def sitemap_stats(urls: DataFrame) -> DataFrame:
    """``kind, bucket, n`` of urls (``priority, changefreq``): how many have each priority, down to a tenth, and
    each change frequency. No priority, or 0, counts as 0.5, no frequency as unknown."""
    p = F.floor(F.coalesce(F.when(F.col("priority") != 0, F.col("priority")), F.lit(0.5)) * 10) / 10
    f = F.coalesce(F.when(F.col("changefreq") != "", F.col("changefreq")), F.lit("unknown"))
    both = urls.select(F.explode(F.array(F.struct(F.lit("priority").alias("kind"), p.cast("string").alias("bucket")), F.struct(F.lit("changefreq").alias("kind"), f.alias("bucket")))).alias("x"))
    return both.groupBy("x.kind", "x.bucket").agg(F.count("*").alias("n"))
