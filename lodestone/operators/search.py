"""Lexical, vector and hybrid retrieval over whole tables, and rank fusion.

``queries`` has ``query_id`` and ``text`` or ``vector``; ``docs`` has ``id`` and ``text`` or
``vector``. All queries run in one job. Ties go to the smaller id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import cosine, word_array
from lodestone.operators.joins import contained_in
from lodestone.operators.postings import top_scores
from lodestone.plans.stages import broadcast_if_small, materialise

K1, B, RRF = 1.2, 0.75, 60


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def top(rows: DataFrame, k: int, score: str = "score", key: str = "query_id", id_col: str = "id") -> DataFrame:
    """The k best rows of each query with their ``rank``."""
    w = Window.partitionBy(key).orderBy(F.desc(score), id_col)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25_postings(queries: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The queries' distinct terms (``query_id, term``), and for these ``term, id, part``: what a term adds to a document's BM25.

    Texts are read once: only the queries' terms and one mark of each document, which tells their number and mean length, leave
    the scan, and are counted before the shuffle.
    """
    q = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    mark = F.array(F.lit(""))
    wanted = broadcast_if_small(q.select("term").union(docs.sparkSession.range(1).select(F.lit(""))).distinct())
    d = docs.select("id", terms(F.col("text")).alias("w")).select("id", F.coalesce(F.size("w"), F.lit(0)).alias("len"), F.explode(F.concat(F.coalesce("w", F.slice(mark, 1, 0)), mark)).alias("term"))
    tf = materialise(d.join(wanted, "term").groupBy("term", "id", "len").agg(F.count("*").alias("tf")), "terms")
    n, mean = tf.where("term = ''").agg(F.sum("tf"), F.sum(F.col("len") * F.col("tf")) / F.sum("tf")).first()
    tf = tf.where("term <> ''")
    df = broadcast_if_small(tf.groupBy("term").agg(F.count("*").alias("df")))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(float(mean or 1))))
    return q, tf.join(df, "term").select("term", "id", part.alias("part"))


def bm25_scores(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """``query_id, id, score`` of every document that shares a term with a query; :func:`bm25` gives the best of them without the others."""
    q, parts = bm25_postings(queries, docs)
    return q.join(parts, "term").groupBy("query_id", "id").agg(F.round(F.sum("part"), 6).alias("score"))


def bm25(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """``query_id, id, score, rank``: the k best documents by BM25."""
    return top_scores(*bm25_postings(queries, docs), k)


#: Vectors of a block. A task holds one block of queries, one of vectors, and their scores.
BLOCK = 1024


def _usable(df: DataFrame, key: str, *more: str) -> DataFrame:
    """``key, v`` of the rows whose vector is there and holds finite numbers only."""
    fine = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return df.select(key, F.col("vector").cast("array<double>").alias("v"), *more).where(F.col("v").isNotNull() & (F.size("v") > 0) & fine)


def knn(queries: DataFrame, vectors: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """``query_id, id, score, rank``: the k most similar vectors by exact cosine.

    Queries and vectors are dealt into blocks, whose numbers follow the counts of both; each pair of blocks is
    one group, which gives its k best for each query, so that the last ranking sees k rows of a block instead
    of all. With ``by``, a column of the vectors, the k best of each of its values are given beside ``by``.
    Vectors that are null, empty or hold null or infinite numbers have no hits, nor have those of another
    length than the query's; the similarity with a vector of zeros is 0.
    """
    q, v = _usable(queries, "query_id"), _usable(vectors, "id", *([by] if by else []))
    qn, vn = (max(1, -(-df.count() // BLOCK)) for df in (q, v))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q = q.withColumn("qb", F.pmod(F.xxhash64("query_id", "v"), F.lit(qn))).withColumn("vb", every(vn))
    v = v.withColumn("vb", F.pmod(F.xxhash64("id", "v"), F.lit(vn))).withColumn("qb", every(qn))
    names = ["query_id", "id", "score"] + ([by] if by else [])
    kind = {"score": "double"} | {f.name: f.dataType.simpleString() for f in [*queries.schema, *vectors.schema]}

    def block(left, right):
        import numpy as np
        import pandas as pd

        out = []
        right = right.assign(size=right["v"].map(len)).sort_values("id", kind="stable")
        for size, some in left.groupby(left["v"].map(len)):
            a = np.stack(some["v"].to_list())
            asked, length = some["query_id"].to_numpy(), np.linalg.norm(a, axis=1)
            own = right[right["size"] == size]
            for value, rows in own.groupby(by, dropna=False) if by else [(None, own)]:
                if not len(rows):
                    continue
                b = np.stack(rows["v"].to_list())
                n = np.outer(length, np.linalg.norm(b, axis=1))
                score = np.round(np.divide(a @ b.T, n, out=np.zeros_like(n), where=n > 0), 6) + 0.0
                best = np.argsort(-score, axis=1, kind="stable")[:, :k]
                x = pd.DataFrame({"query_id": np.repeat(asked, best.shape[1]), "id": rows["id"].to_numpy()[best.ravel()], "score": np.take_along_axis(score, best, 1).ravel()})
                out.append(x.assign(**{by: value}) if by else x)
        return pd.concat(out)[names] if out else pd.DataFrame(columns=names)

    near = q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInPandas(block, ", ".join(f"`{c}` {kind[c]}" for c in names))
    w = Window.partitionBy("query_id", *([by] if by else [])).orderBy(F.desc("score"), "id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hybrid(lexical: DataFrame, vector: DataFrame, k: int, w_lex: float = 1.0, w_vec: float = 1.0, allowed: DataFrame | None = None) -> DataFrame:
    """``query_id, id, score, clamped, rank``: the weighted sum of both scores (``query_id, id, score``).

    ``allowed`` holds the ids that pass a filter of the metadata; it applies to both sides.
    """
    if allowed is not None:
        ids = broadcast_if_small(allowed.select("id").distinct())
        lexical, vector = lexical.join(ids, "id", "left_semi"), vector.join(ids, "id", "left_semi")
    x = lexical.select("query_id", "id", F.col("score").alias("a")).join(vector.select("query_id", "id", F.col("score").alias("b")), ["query_id", "id"], "full")
    score = F.round(w_lex * F.coalesce("a", F.lit(0.0)) + w_vec * F.coalesce("b", F.lit(0.0)), 6)
    x = x.select("query_id", "id", score.alias("score"))
    return top(x, k).withColumn("clamped", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))))


def hybrid_by_key(queries: DataFrame, docs: DataFrame, vector: DataFrame, k: int, w_lex: float = 1.0, w_vec: float = 1.0, allowed: DataFrame | None = None) -> DataFrame:
    """:func:`hybrid` whose lexical side gives a query (``query_id, key``) every row of its key (``id, key, score``).

    A key's rows score the same for each of its queries, so they are ranked once for the key and not for each query: of the
    rows that are no hit of ``vector`` k are enough, and hits are looked up. Nothing is made for each query and row of a key.
    """
    if allowed is not None:
        ids = broadcast_if_small(allowed.select("id").distinct())
        docs, vector = docs.join(ids, "id", "left_semi"), vector.join(ids, "id", "left_semi")
    vector = materialise(vector.select("query_id", "id", "score"), "near")
    most = vector.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
    alone = F.round(w_lex * F.coalesce("score", F.lit(0.0)), 6)
    best = docs.where("key is not null").withColumn("n", F.dense_rank().over(Window.partitionBy("key").orderBy(alone.desc(), "id"))).where(F.col("n") <= k + most)
    asked, hits = queries.select("query_id", "key"), vector.select("query_id", "id").distinct()
    names = ["query_id", "id", "score"]
    others = asked.join(best, "key").select(names).join(hits, ["query_id", "id"], "left_anti")
    shared = hits.join(asked, "query_id").join(docs, ["id", "key"]).select(names)
    return hybrid(others.union(shared), vector, k, w_lex, w_vec)


def rrf(*rankings: DataFrame, k: int = 10, constant: int = RRF) -> DataFrame:
    """``query_id, id, score, rank``: reciprocal rank fusion of ``query_id, id, rank``."""
    x = reduce(DataFrame.union, [r.select("query_id", "id", "rank") for r in rankings])
    return top(x.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("score")), k)


def nearest_ids(queries: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """``query_id, id, rank``: the k numerically nearest ids of each query, at any distance.

    Ids are dealt into cells; a query meets its own and both neighbouring cells, which hold
    all ids up to a cell's width away. Queries with fewer than k ids that near go on to
    cells four times as wide, until a cell is as wide as all ids.
    """
    left = materialise(queries.select("query_id").distinct(), "asked")
    own = ids.select("id").where("id is not null")
    low, high = left.select(F.col("query_id").alias("id")).union(own).agg(F.min("id"), F.max("id")).first()
    w = Window.partitionBy("query_id").orderBy(F.abs(F.col("id") - F.col("query_id")), "id")
    width, out = 2 * k, None
    while True:
        cell = lambda c: F.expr(f"(({c}) - pmod(({c}), {width}L)) div {width}L")  # noqa: B023, E731
        q = left.select("query_id", F.explode(F.array(*(cell("query_id") + i for i in (-1, 0, 1)))).alias("cell"))
        near = q.join(own.withColumn("cell", cell("id")), "cell").where(F.abs(F.col("id") - F.col("query_id")) <= width)
        near = materialise(near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "id", "rank"), "near")
        if low is None or width >= high - low:
            return near if out is None else out.union(near)
        done = near.where(F.col("rank") == k).select("query_id")
        found = near.join(done, "query_id", "left_semi")
        out = found if out is None else out.union(found)
        left = materialise(left.join(done, "query_id", "left_anti"), "asked")
        if left.isEmpty():
            return out
        width *= 4


def similar(queries: DataFrame, vectors: DataFrame, least: float, k: int) -> DataFrame:
    """The k most similar of the vectors with at least ``least``."""
    return knn(queries, vectors, k).where(F.col("score") >= least)


def architecture_search(hits: DataFrame, k: int) -> DataFrame:
    """Hits (``query_id, id, level, score``) of level 1 and up and similarity 0.2 and up, by score times
    (1 + 0.25 * level)."""
    x = hits.where("level >= 1 and score >= 0.2").withColumn("score", F.round(F.col("score") * (1 + 0.25 * F.col("level")), 8))
    return top(x, k)


def global_search(hits: DataFrame, children: DataFrame, strengths: DataFrame, k: int) -> DataFrame:
    """The k best communities by level, then score, with up to 5 children and 3 interactions."""
    w = Window.partitionBy("query_id").orderBy(F.desc("level"), F.desc("score"), "id")
    best = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    c = children.groupBy(F.col("community").alias("id")).agg(F.slice(F.array_sort(F.collect_set("child")), 1, 5).alias("children"))
    s = strengths.groupBy(F.col("a").alias("id")).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("strength")).alias("s"), "b"))), 1, 3).alias("interactions"))
    return best.join(c, "id", "left").join(s, "id", "left")


def probe_texts(anchors: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """``query_id, text``: what to search for an anchor: its name and its extra keys (``anchor, n, key``) in their order,
    trimmed, without blank and repeated ones, joined by spaces."""
    own = anchors.select("anchor").distinct()
    rows = own.select("anchor", F.struct(F.lit(0).alias("own"), F.lit(0).cast("long").alias("n"), F.col("anchor").cast("string").alias("key")).alias("k"))
    if keys is not None:
        more = keys.join(own, "anchor", "left_semi").select("anchor", F.struct(F.lit(1).alias("own"), F.col("n").cast("long").alias("n"), F.col("key").cast("string").alias("key")).alias("k"))
        rows = rows.union(more)
    x = rows.groupBy("anchor").agg(F.array_sort(F.collect_list("k")).alias("k"))
    named = F.filter(F.transform("k", lambda k: F.trim(k["key"])), lambda k: k.isNotNull() & (k != ""))
    return x.select(F.col("anchor").alias("query_id"), F.array_join(F.array_distinct(named), " ").alias("text"))


def context(neighbours: DataFrame, hits: DataFrame, anchors: DataFrame | None = None, documents: int = 5) -> DataFrame:
    """``anchor, neighbours, documents, tokens, graph_count, semantic_count`` from scored neighbours (bounded by their budget) and
    the first ``documents`` hits of each anchor; with ``anchors`` a row for each, without results too."""
    a = neighbours.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "name", "rel"))).alias("neighbours"), F.max("used").alias("tokens"), F.count("*").alias("graph_count"))
    b = hits.where(F.col("rank") <= documents).groupBy(F.col("query_id").alias("anchor")).agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("documents"), F.count("*").alias("semantic_count"))
    x = a.join(b, "anchor", "full")
    x = anchors.select("anchor").distinct().join(x, "anchor", "left") if anchors is not None else x
    return x.fillna(0, ["tokens", "graph_count", "semantic_count"])


def text_relevance(queries: DataFrame, chunks: DataFrame, k: int, least: float = 0.1) -> DataFrame:
    """0.6 * Jaccard of content + 0.3 * Jaccard of title + 0.1 * keyword coverage, above ``least``.

    Shared words are counted over an inverted index, before the shuffle where they can be, and with the numbers
    of words give the score; no text goes along. Pairs without a shared word score 0. Each id is that of one row.
    """
    words = lambda c: F.array_distinct(word_array(F.lower(F.coalesce(c, F.lit("")))))
    q = queries.select("query_id", words(F.col("text")).alias("q")).select("query_id", F.size("q").alias("n"), F.explode("q").alias("w"))
    c = chunks.select("id", words(F.col("text")).alias("text"), words(F.col("title")).alias("title"))
    of = lambda name, i: F.transform(name, lambda w: F.struct(w.alias("w"), F.lit(i).alias("in_title")))
    c = c.select("id", F.size("text").alias("in_text_n"), F.size("title").alias("in_title_n"), F.explode(F.concat(of("text", 0), of("title", 1))).alias("x"))
    hit = c.select("id", "in_text_n", "in_title_n", "x.w", "x.in_title").join(broadcast_if_small(q), "w").groupBy("query_id", "id", "n", "in_text_n", "in_title_n")
    hit = hit.agg(F.sum(1 - F.col("in_title")).alias("text"), F.sum("in_title").alias("title"))
    jaccard = lambda part: F.col(part) / (F.col("n") + F.col(f"in_{part}_n") - F.col(part))
    score = 0.6 * jaccard("text") + 0.3 * jaccard("title") + 0.1 * (F.col("text") / F.col("n"))
    return top(hit.select("query_id", "id", F.round(score, 6).alias("score")).where(F.col("score") > least), k)


def category_search(postings: DataFrame, words: DataFrame, k: int) -> DataFrame:
    """Best of matches * weight (``query_id, id, matches, weight``) and hits * importance of each id."""
    a = postings.select("query_id", "id", (F.col("matches") * F.col("weight")).alias("score"))
    b = words.select("query_id", "id", (F.col("hits") * F.col("importance")).alias("score"))
    return top(a.union(b).groupBy("query_id", "id").agg(F.max("score").alias("score")), k)


def keyword_search(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """``query_id, id, score, rank``: the k documents with most distinct terms of a query, whose number is the score."""
    q = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    d = docs.select("id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).join(broadcast_if_small(q.select("term").distinct()), "term", "left_semi")
    return top_scores(q, d.select("term", "id", F.lit(1.0).alias("part")), k).withColumn("score", F.col("score").cast("long"))


def explain(topics: DataFrame, hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hits of each topic (``query_id, text``) and the nodes whose name contains it, whatever the case.

    An empty topic has no nodes.
    """
    t = topics.select("query_id", F.lower("text").alias("short"))
    n = nodes.select("node_id", F.lower("name").alias("long"))
    near = contained_in(t.select("short"), n.select("long")).join(t, "short").join(n, "long")
    near = near.select("query_id", F.lit("graph").alias("kind"), F.col("node_id").cast("string").alias("id"))
    return hits.select("query_id", F.lit("text").alias("kind"), F.col("id").cast("string").alias("id")).union(near)


def compare_profiles(rankings: dict[str, DataFrame]) -> DataFrame:
    """``query_id, a, b, overlap``: Jaccard overlap of each two profiles' results."""
    own = [r.groupBy("query_id").agg(F.collect_set("id").alias("ids")).withColumn("profile", F.lit(p)) for p, r in rankings.items()]
    x = reduce(DataFrame.union, own)
    y = x.select("query_id", F.col("ids").alias("other"), F.col("profile").alias("b"))
    j = F.size(F.array_intersect("ids", "other")) / F.size(F.array_union("ids", "other"))
    return x.join(y, "query_id").where("profile < b").select("query_id", F.col("profile").alias("a"), "b", F.round(j, 6).alias("overlap"))


def search_source(queries: DataFrame, chunks: DataFrame, source: str, k: int, least_quality: float = 0.5) -> DataFrame:
    """Text relevance among one source's chunks of at least a quality (0.5 where none is given)."""
    return text_relevance(queries, chunks.where((F.col("source") == source) & (F.coalesce("quality", F.lit(0.5)) >= least_quality)), k)


def attribute(hits: DataFrame) -> DataFrame:
    """Hits with an ``attribution`` of source, path and url, unknown where missing."""
    return hits.withColumn("attribution", F.struct(*(F.coalesce(F.col(c), F.lit("unknown")).alias(c) for c in ("source", "path", "url") if c in hits.columns)))


def similarity_link(nodes: DataFrame, docs: DataFrame, most: float = 0.3) -> DataFrame:
    """``src, dst, rel``: each node's nearest document, if its cosine distance is at most ``most``."""
    best = knn(nodes.select(F.col("id").alias("query_id"), "vector"), docs, 1)
    return best.where(1 - F.col("score") <= most).select(F.col("query_id").alias("src"), F.col("id").alias("dst"), F.lit("DOCUMENTED_BY").alias("rel"))


def hash_embed(docs: DataFrame, dim: int = 256) -> DataFrame:
    """``id, vector``: hashed TF-IDF vectors of length one, in place of a hosted embedder."""
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    tf = HashingTF(inputCol="w", outputCol="tf", numFeatures=dim).transform(docs.select("id", terms(F.col("text")).alias("w")))
    x = IDF(inputCol="tf", outputCol="idf").fit(tf).transform(tf)
    return Normalizer(inputCol="idf", outputCol="unit").transform(x).select("id", vector_to_array("unit").cast("array<float>").alias("vector"))


def multi_search(hits: dict[str, DataFrame], k: int) -> DataFrame:
    """The k best of all collections' hits (``query_id, id, content, score``); of contents that begin
    alike the best one."""
    from lodestone.operators.joins import multi_collection
    from lodestone.operators.ranking import merge_topk

    return merge_topk(multi_collection(hits), "query_id", k)
