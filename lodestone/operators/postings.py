"""Top-k retrieval over posting lists with bounds, so that common words add to scores but make no candidates.

A posting ``term, id, part`` says how much a term adds to a document's score; a term's largest part bounds what any
document can get from it. Of a query's terms those with the smallest bounds, as many as together make up at most
:data:`UNREAD` of the sum of all, are not read at first: these are the words that very many documents have. The sums over the
others' postings are lower bounds of the scores, so their k-th largest is a threshold, and a
document whose sum stays below it by more than the unread terms' bounds cannot be among the k. The few that are left get
the unread terms' parts by a join on term and document. A query whose threshold the unread terms could
reach alone is read in full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.stages import materialise

#: Share of a query's bounds that is not read at first.
UNREAD = 0.1
#: Scores are rounded to this many digits before they are ranked; bounds leave more than that.
DIGITS, SLACK = 6, 1e-5


def _sums(asked: DataFrame, posts: DataFrame) -> DataFrame:
    return asked.join(posts, "term").groupBy("query_id", "id").agg(F.sum("part").alias("part"))


def top_scores(asked: DataFrame, postings: DataFrame, k: int, unread: float = UNREAD) -> DataFrame:
    """``query_id, id, score, rank``: of each query (``query_id, term``, distinct) the k documents with the highest sums of parts.

    Exact: what is left out cannot be among them. Parts are positive, and a term has one for a document. Ties go to the
    smaller id. Queries without a term that a posting has give no rows, nor do empty tables; a null term
    matches nothing. Ranks are limited to k in every task before rows are shuffled by query.
    """
    posts = materialise(postings.select("term", "id", "part"), "postings")
    bounds = posts.groupBy("term").agg(F.max("part").alias("top"), F.count("*").alias("df"))
    up = Window.partitionBy("query_id").orderBy("top", F.desc("df"), "term").rowsBetween(Window.unboundedPreceding, 0)
    q = asked.select("query_id", "term").join(bounds, "term").withColumn("below", F.sum("top").over(up))
    q = q.withColumn("late", F.col("below") <= unread * F.sum("top").over(Window.partitionBy("query_id")))
    q = materialise(q.select("query_id", "term", "below", "late"), "asked")
    early, late = q.where("not late").select("query_id", "term"), q.where("late")
    sums = materialise(_sums(early, posts), "sums")
    best = Window.partitionBy("query_id").orderBy(F.desc("part"), "id")
    kth = sums.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("part") - SLACK).alias("least"))
    rest = q.groupBy("query_id").agg(F.coalesce(F.max(F.when(F.col("late"), F.col("below"))), F.lit(0.0)).alias("rest"))
    limit = materialise(rest.join(kth, "query_id", "left").withColumn("whole", F.coalesce("rest", F.lit(0.0)) >= F.coalesce("least", F.lit(0.0))), "limits")
    near = sums.join(limit.where("not whole"), "query_id").where("part + rest >= least").select("query_id", "id", "part")
    more = near.select("query_id", "id").join(late.select("query_id", "term"), "query_id").join(posts, ["term", "id"]).select("query_id", "id", "part")
    whole = _sums(q.join(limit.where("whole"), "query_id", "left_semi").select("query_id", "term"), posts)
    out = near.union(more).groupBy("query_id", "id").agg(F.sum("part").alias("part")).union(whole)
    out = out.select("query_id", "id", F.round("part", DIGITS).alias("score"))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
