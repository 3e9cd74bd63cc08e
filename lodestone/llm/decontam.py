"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is contained in a document if at least 80 % of its distinct 5-word shingles occur
there. Items are partitioned by their number of shingles n, and each partition's items are
sketched by their m(n) smallest shingle hashes, with m(n) = floor(n / 5) + 1: a document
that lacks at most a fifth of the shingles has one of any m(n) of them, so every contained
item shares a sketch hash with its document, however long that is. The document side is not
sketched, because a short item's shingles are no minima of a long document. Candidates are
verified by counting the item's exact shingles, as text, in the document.

Built-in expressions only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.plans.stages import broadcast_if_small, materialise

#: Words in a shingle, and the least percentage of an item's shingles.
WORDS, PERCENT = 5, 80
WORD_GAP = r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    """Lower-cased words of a text column; null for null."""
    return F.filter(F.split(F.lower(text), WORD_GAP), lambda w: w != "")


def _places(rows: DataFrame, k: int | None) -> tuple[DataFrame, int]:
    """``id, words, at`` of each place at which k words begin; without k five words, or a shorter text as a whole."""
    n = F.size("words")
    if k:
        return rows.where(n >= k).select("id", "words", F.explode(F.sequence(F.lit(0), n - k)).alias("at")), k
    at = F.explode(F.when(n >= WORDS, F.sequence(F.lit(0), n - WORDS)).when(n > 0, F.array(F.lit(0))))
    return rows.where(n > 0).select("id", "words", at.alias("at")), WORDS


def _shingles(rows: DataFrame, k: int | None = None) -> DataFrame:
    """``id, shingle`` from ``id, words``: the texts' shingles; a shorter text is one shingle."""
    x, n = _places(rows, k)
    return x.select("id", F.concat_ws(" ", *(F.get("words", F.col("at") + i) for i in range(n))).alias("shingle"))


def _probe(rows: DataFrame, k: int | None = None) -> DataFrame:
    """``id, hash`` of each shingle of ``id, words``, without making its text; missing words do not change a hash."""
    x, n = _places(rows, k)
    return x.select("id", F.xxhash64(*(F.get("words", F.col("at") + i) for i in range(n))).alias("hash"))


def _with_short(make: Callable[..., DataFrame], rows: DataFrame, sizes: list[int]) -> DataFrame:
    """``make`` of the rows, and for each size of shorter items of all their runs of so many words."""
    return reduce(DataFrame.union, [make(rows), *(make(rows, k) for k in sizes)])


def contained_items(docs: DataFrame, items: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, n_shared, n_item`` for each item contained in a document.

    Words are runs without ASCII white space, lower-cased. An item of fewer than five words
    is one shingle of its own size, and is found wherever a document has those words. Null and empty texts
    take no part on either side; rows that repeat an id count as one text's shingles; other
    columns are not read. Items are broadcast while their counted sketches are few and
    joined by a shuffle beyond that.
    """
    own = docs.select(F.col(id_col).alias("id"), _words(F.col(text_col)).alias("words"))
    query = items.select(F.col(item_col).alias("id"), _words(F.col(text_col)).alias("words"))
    # of the sizes below five those that some item has
    short = query.where((F.size("words") > 0) & (F.size("words") < WORDS)).select(F.size("words").alias("n")).distinct()
    sizes = sorted(r["n"] for r in short.collect())
    exact = materialise(_shingles(query).distinct().select(F.col("id").alias("item"), "shingle"), "items")
    size = exact.groupBy("item").agg(F.count("*").alias("n_item"))
    hashed = _probe(query).distinct().join(size, F.expr("id = item"))
    # the partition of items with n shingles keeps m(n) minima
    spare = F.floor(F.col("n_item") * (100 - percent) / 100).cast("int") + 1
    minima = hashed.groupBy("id", "n_item").agg(F.array_sort(F.collect_set("hash")).alias("all"))
    sketch = materialise(minima.select(F.col("id").alias("item"), F.explode(F.slice("all", F.lit(1), spare)).alias("hash")), "sketch")

    hits = _with_short(_probe, own, sizes).join(broadcast_if_small(sketch), "hash").select("id", "item").distinct()
    hits = materialise(hits, "candidates")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = texts.join(hits.select("id").distinct().hint("merge"), "id", "left_semi")
    # only shingles of some item are kept, before anything is shuffled
    kept = _with_short(_shingles, found.select("id", _words(F.col("text")).alias("words")), sizes).join(broadcast_if_small(exact), "shingle").select("id", "item", "shingle").distinct()
    shared = kept.groupBy("id", "item").agg(F.count("*").alias("n_shared")).join(hits, ["id", "item"], "left_semi").join(size, "item")
    shared = shared.where(F.col("n_shared") * 100 >= F.col("n_item") * percent)
    return shared.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_shared", "n_item")


def oracle_sql(percent: int = PERCENT) -> str:
    """The same pairs in DuckDB's SQL, from all shingles of both tables."""

    def grams(name: str, key: str) -> str:
        return f"""
        {name}_w AS (SELECT {key} AS id, list_filter(string_split_regex(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {name} WHERE text IS NOT NULL),
        {name}_s AS (SELECT DISTINCT id, array_to_string(w[a : a + {WORDS - 1}], ' ') AS g
            FROM (SELECT id, w, unnest(range(1, greatest(len(w) - {WORDS - 1}, 1) + 1)) AS a FROM {name}_w WHERE len(w) > 0) u)"""

    return f"""
        WITH {grams('documents', 'doc_id')}, {grams('benchmark', 'item_id')},
        sizes AS (SELECT DISTINCT len(w) AS k FROM benchmark_w WHERE len(w) BETWEEN 1 AND {WORDS - 1}),
        places AS (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS a FROM documents_w, sizes WHERE len(w) >= k),
        held AS (SELECT id, g FROM documents_s UNION SELECT id, array_to_string(w[a : a + k - 1], ' ') FROM places),
        n AS (SELECT id, count(*) AS n_item FROM benchmark_s GROUP BY id),
        pairs AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared FROM held d JOIN benchmark_s b ON d.g = b.g GROUP BY 1, 2)
        SELECT doc_id, item_id, n_shared, n_item FROM pairs JOIN n ON n.id = pairs.item_id WHERE 100 * n_shared >= {percent} * n_item"""
