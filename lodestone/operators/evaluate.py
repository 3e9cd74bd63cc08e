"""Retrieval metrics over rankings (``query_id, id, rank``) and judgements (``query_id, id``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.stages import broadcast_if_small, materialise


def metrics(rankings: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """``query_id, precision, recall, rr, ndcg`` of every judged query; no hits give 0."""
    rel = qrels.select("query_id", "id").distinct()
    hits = rankings.where(F.col("rank") <= k).join(rel, ["query_id", "id"]).groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
    per = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    n = rel.groupBy("query_id").agg(F.count("*").alias("total"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("total"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    x = n.join(per, "query_id", "left")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return x.select("query_id", zero(F.col("n") / k).alias("precision"), zero(F.col("n") / F.col("total")).alias("recall"), zero(1 / F.col("first")).alias("rr"), zero(F.col("dcg") / ideal).alias("ndcg"))


def mean_metrics(per_query: DataFrame) -> DataFrame:
    """One row of the metrics' means."""
    return per_query.agg(*(F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "rr", "ndcg")))


def keyword_metrics(results: DataFrame, k: int) -> DataFrame:
    """``query_id, precision, recall, rr, coverage`` of result texts (``query_id, rank, text, expected array``).

    A keyword counts once, whichever of the query's texts holds it; ``rr`` is one over the first rank up to k
    whose text holds any; ``coverage`` is the share of keywords found. Without keywords all are 0.
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    held = F.filter(F.array_distinct("expected"), lambda w: F.contains(low, F.lower(w)))
    x = results.select("query_id", "rank", F.size(F.array_distinct("expected")).alias("n"), held.alias("held"))
    first = F.min(F.when((F.size("held") > 0) & (F.col("rank") <= k), F.col("rank")))
    per = x.groupBy("query_id").agg(F.max("n").alias("n"), first.alias("first"))
    found = x.select("query_id", F.explode("held").alias("w")).distinct().groupBy("query_id").agg(F.count("*").alias("found"))
    one = lambda c: F.round(F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))), 4)
    hit = F.when(F.col("n") > 0, F.col("found"))
    out = per.join(found, "query_id", "left")
    return out.select("query_id", one(hit / F.least(F.lit(k), F.col("n"))).alias("precision"), one(hit / F.col("n")).alias("recall"), one(1 / F.col("first")).alias("rr"), one(hit / F.col("n")).alias("coverage"))


def is_hit(text: Column, names: Column, keywords: Column) -> Column:
    """Any expected name in the text, or at least half of the keywords."""
    low = F.lower(text)
    any_name = F.exists(names, lambda x: F.contains(low, F.lower(x)))
    many = F.size(F.filter(keywords, lambda x: F.contains(low, F.lower(x)))) >= F.ceil(F.size(keywords) / 2)
    return F.coalesce(any_name, F.lit(False)) | (F.coalesce(F.size(keywords) > 0, F.lit(False)) & F.coalesce(many, F.lit(False)))


def latency_percentiles(rows: DataFrame, key: str, value: str, p: float) -> DataFrame:
    """``key, nearest, floor_index, linear`` percentiles by the three definitions; nulls are left out.

    Equal values are counted first; the distinct ones are dealt by ranges, so that one key's values may lie in
    many tasks, and the counts of the ranges before give each value its place.
    """
    x = rows.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("k"), F.col(value).alias("v")).agg(F.count("*").alias("c"))
    x = materialise(x.repartitionByRange("k", "v").withColumn("part", F.spark_partition_id()), "ranges")
    parts = x.groupBy("k", "part").agg(F.sum("c").alias("c"))
    w = Window.partitionBy("k").orderBy("part")
    parts = parts.select("k", "part", (F.sum("c").over(w) - F.col("c")).alias("before"), F.sum("c").over(Window.partitionBy("k")).alias("n"))
    same = F.expr("x.k <=> parts.k AND x.part = parts.part")
    y = x.alias("x").join(broadcast_if_small(parts).alias("parts"), same).select("x.k", "x.part", "v", "c", "before", "n")
    last = F.col("before") + F.sum("c").over(Window.partitionBy("k", "part").orderBy("v"))
    y = y.withColumn("last", last).withColumn("first", F.col("last") - F.col("c") + 1)
    n, at = F.col("n"), (F.col("n") - 1) * F.lit(p)
    places = {"nearest": F.greatest(F.ceil(n * p), F.lit(1)), "floor_index": F.least(F.floor(n * p), n - 1) + 1, "low": F.floor(at) + 1, "high": F.ceil(at) + 1}
    pick = {name: F.max(F.when(place.between(F.col("first"), F.col("last")), F.col("v"))) for name, place in places.items()}
    out = y.groupBy("k").agg(F.first("n").alias("n"), *(c.alias(name) for name, c in pick.items()))
    linear = F.round(F.col("low") + (F.col("high") - F.col("low")) * (at - F.floor(at)), 6)
    return out.select(F.col("k").alias(key), "nearest", "floor_index", linear.alias("linear"))


def system_comparison(results: DataFrame) -> DataFrame:
    """``category, system, hit_rate`` of ``category, system, hit``."""
    return results.groupBy("category", "system").agg(F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"))


def regressions(before: DataFrame, after: DataFrame, warn: float = 0.05, critical: float = 0.15) -> DataFrame:
    """``metric, before, after, drop, level`` of metrics that fell; a previous 0 is left out."""
    x = before.select("metric", F.col("value").alias("before")).join(after.select("metric", F.col("value").alias("after")), "metric").where("before <> 0")
    x = x.withColumn("drop", F.round((F.col("before") - F.col("after")) / F.col("before"), 6))
    return x.withColumn("level", F.when(F.col("drop") > critical, "critical").when(F.col("drop") > warn, "warn").otherwise("ok"))


def composite_score(latency: Column, relevance: Column, completeness: Column, graph: Column, errors: Column) -> Column:
    """0.3 latency + 0.3 relevance + 0.2 completeness + 0.1 graph + 0.1 errors."""
    return 0.3 * latency + 0.3 * relevance + 0.2 * completeness + 0.1 * graph + 0.1 * errors


def overlap_at_k(a: Column, b: Column, k: int) -> Column:
    """Share of the first ranking's k results that are among the other's k."""
    x, y = F.slice(a, 1, k), F.slice(b, 1, k)
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.lit(1))


def chain_evaluation(chains: DataFrame, neighbours: DataFrame) -> DataFrame:
    """``chain_id, hit, rank, rel_match``: whether entity2 is among entity1's scored neighbours."""
    w = Window.partitionBy("anchor").orderBy(F.desc("score"), "name")
    n = neighbours.withColumn("rank", F.row_number().over(w))
    x = chains.join(n, F.expr("entity1 = anchor"), "left")
    same = F.contains(F.lower("name"), F.lower("entity2")) | F.contains(F.lower("entity2"), F.lower("name"))
    x = x.withColumn("r", F.when(same, F.col("rank"))).withColumn("m", F.when(same, F.col("rel") == F.col("expected_relationship")))
    return x.groupBy("chain_id").agg(F.min("r").isNotNull().alias("hit"), F.min("r").alias("rank"), F.coalesce(F.min_by("m", "r"), F.lit(False)).alias("rel_match"))


def weight_search(edges: DataFrame, chains: DataFrame, weights: DataFrame, step: float = 0.1) -> DataFrame:
    """``trial_rel, delta, mean_rank, hits``: one step up and down (and two) of every relationship's weight."""
    deltas = F.explode(F.array(*(F.lit(float(d * step)) for d in (-2, -1, 1, 2))))
    trial = weights.select(F.col("rel").alias("trial_rel"), deltas.alias("delta"))
    one = chains.select("chain_id", "entity1", "entity2").join(edges, F.expr("entity1 = src")).join(weights, "rel", "left")
    x = one.withColumn("k", F.lit(1)).join(F.broadcast(trial.withColumn("k", F.lit(1))), "k")  # four rows for each relationship of the vocabulary
    score = F.coalesce("weight", F.lit(0.3)) + F.when(F.col("rel") == F.col("trial_rel"), F.col("delta")).otherwise(0.0)
    w = Window.partitionBy("trial_rel", "delta", "chain_id").orderBy(F.desc("score"), "dst")
    x = x.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where("dst = entity2")
    return x.groupBy("trial_rel", "delta").agg(F.round(F.avg("rank"), 6).alias("mean_rank"), F.count("*").alias("hits"))


def agreement(found: DataFrame, truth: DataFrame) -> DataFrame:
    """``path, kind, name, side``: facts missing from, or spurious in, the found ones."""
    keys = ["path", "kind", "name"]
    miss = truth.select(keys).join(found.select(keys), keys, "left_anti").withColumn("side", F.lit("missing"))
    return miss.union(found.select(keys).join(truth.select(keys), keys, "left_anti").withColumn("side", F.lit("spurious")))
