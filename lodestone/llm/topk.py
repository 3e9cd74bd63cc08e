"""Exact top-k inner products with block-at-a-time pruning.

Vectors become integers, floor(1024 x). Candidates are grouped into document-range blocks
of neighbouring ids; a block's summary holds each term's (dimension's) largest and smallest
value. A query's bound on a block is the sum over terms of the larger of the two products,
so no vector of the block scores higher. In a first step each query's most promising block
is scored through its forward index (the block's matrix of vectors), which gives a k-th
score to beat; in the second, blocks are taken in the order of their bounds until these
fall below the k-th score.

Queries go out in blocks too. For bounds a task gets ``GROUP`` query blocks and the summaries of a
slice of the candidate blocks, for scores one query block and a slice of the candidate blocks
themselves, so what it holds is bounded whatever the tables' sizes; a candidate block is only
sent to query blocks that have a query whose bound reaches the k-th score of the first step.
Products are taken in floating point only where every sum is an exact integer there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.stages import broadcast_if_small, materialise

#: Ids in a candidate block and in a query block, candidate blocks in a slice, and query blocks in a group.
BLOCK, QUERIES, SLICE, GROUP = 512, 256, 32, 32
SCALE = 1024


def integers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v array<long>`` of the vectors without null or non-finite components."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("x")).where(F.col("id").isNotNull() & F.col(vector_col).isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return rows.select("id", F.transform("x", lambda x: F.floor(x * SCALE).cast("long")).alias("v"))


def _pack(rows: DataFrame, size: int) -> DataFrame:
    """One row for each range of ``size`` ids and vector length: its ids, matrix and term extremes."""

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", kind="stable")
        m = np.stack(part.v.to_numpy()).astype(np.int64) if key[1] else np.zeros((len(part), 0), np.int64)
        return pd.DataFrame([[key[0], key[1], part.id.to_numpy(np.int64).tobytes(), m.tobytes(), m.max(0).tobytes(), m.min(0).tobytes()]])

    keyed = rows.select(F.floor(F.col("id") / size).cast("long").alias("block"), F.size("v").alias("dim"), "id", "v")
    return keyed.groupBy("block", "dim").applyInPandas(pack, "block long, dim int, ids binary, m binary, hi binary, lo binary")


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of integer matrices; by floating point where no sum can reach 2**53."""
    size = lambda m: max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))
    if size(a) * size(b) * a.shape[1] < 1 << 52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _bounds(q: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Each query's bound on each block."""
    return _times(np.maximum(q, 0), hi) + _times(np.minimum(q, 0), lo)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest integer inner products of each query.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but the
    query's own, ties go to the smaller id. Vectors that are null, have a null id, or hold
    null or non-finite components take no part. Vectors are compared with vectors of the same
    length only. A query with fewer candidates gets them all. Rows that repeat an id are
    candidates each, and each asks for itself, with ranks of its own, among the rows of other ids; an
    empty table gives no rows.
    """
    rows = materialise(integers(vectors, id_col, vector_col), "vectors")
    blocks = materialise(_pack(rows, BLOCK), "blocks")
    asked = materialise(_pack(rows.where(F.pmod("id", F.lit(every)) == 0), QUERIES * every), "queries").withColumnsRenamed({"block": "qblock", "ids": "qids", "m": "qm"}).select("qblock", "dim", "qids", "qm")

    def matrix(raw: bytes, n: int, dim: int) -> np.ndarray:
        return np.frombuffer(raw, np.int64).reshape(n, dim)

    # summaries are 1/256 of the data; they meet the query blocks by vector length, in slices
    sums = blocks.select("dim", "block", F.floor(F.col("block") / (SLICE * 8)).alias("slice"), "hi", "lo")
    slices = broadcast_if_small(sums.select("dim", F.col("slice").alias("qslice")).distinct())
    group = F.floor(F.col("qblock") / GROUP).alias("qgroup")
    groups = broadcast_if_small(asked.select("dim", group).distinct())
    near = sums.join(groups, "dim").groupBy("dim", "slice", "qgroup")
    met = asked.select("*", group).join(slices, "dim").groupBy("dim", "qslice", "qgroup")

    def promise(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(right):
            dim = int(key[0])
            hi, lo = (np.stack([np.frombuffer(x, np.int64) for x in right[c]]) for c in ("hi", "lo"))
            names = right.block.to_numpy()
            for r in left.itertuples():
                ids = np.frombuffer(r.qids, np.int64)
                b = _bounds(matrix(r.qm, len(ids), dim), hi, lo)
                at = b.argmax(1)
                out.append(pd.DataFrame({"qblock": r.qblock, "dim": dim, "n": np.arange(len(ids)), "block": names[at], "bound": b[np.arange(len(ids)), at]}))
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("qblock", "dim", "n", "block", "bound")})

    best = met.cogroup(near).applyInPandas(promise, "qblock long, dim int, n long, block long, bound long")
    first = best.groupBy("qblock", "dim", "n").agg(F.max_by("block", "bound").alias("block"))
    first = first.groupBy("qblock", "dim", "block").agg(F.collect_list("n").alias("ns"))

    def seed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for r in part.itertuples():
                qids, ids = np.frombuffer(r.qids, np.int64), np.frombuffer(r.ids, np.int64)
                ns = np.sort(np.asarray(r.ns, np.int64))
                s = _times(matrix(r.qm, len(qids), r.dim)[ns], matrix(r.m, len(ids), r.dim))
                kth = []
                for i, row in zip(ns, s, strict=True):
                    other = np.sort(row[ids != qids[i]])[::-1]
                    kth.append(int(other[k - 1]) if len(other) >= k else np.iinfo(np.int64).min)
                yield pd.DataFrame({"qblock": r.qblock, "dim": r.dim, "n": ns, "kth": kth})

    seeds = first.join(asked, ["qblock", "dim"]).join(blocks.select("block", "dim", "ids", "m"), ["block", "dim"])
    kth = seeds.mapInPandas(seed, "qblock long, dim int, n long, kth long")
    kth = kth.groupBy("qblock", "dim").agg(F.map_from_entries(F.collect_list(F.struct("n", "kth"))).alias("kth"))
    ready = materialise(asked.join(kth, ["qblock", "dim"], "left"), "ready")

    def floor_of(r: object, n: int) -> np.ndarray:
        low = np.full(n, np.iinfo(np.int64).min)
        for i, x in dict(r.kth or {}).items():
            low[int(i)] = x
        return low

    def admit(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c: pd.Series(dtype="int64") for c in ("qblock", "dim", "block")})]
        if len(right):
            dim = int(key[0])
            hi, lo = (np.stack([np.frombuffer(x, np.int64) for x in right[c]]) for c in ("hi", "lo"))
            names = right.block.to_numpy()
            for r in left.itertuples():
                n = len(r.qids) // 8
                some = (_bounds(matrix(r.qm, n, dim), hi, lo) >= floor_of(r, n)[:, None]).any(0)
                out.append(pd.DataFrame({"qblock": r.qblock, "dim": dim, "block": names[some]}))
        return pd.concat(out)

    pairs = ready.select("*", group).join(slices, "dim").groupBy("dim", "qslice", "qgroup").cogroup(near).applyInPandas(admit, "qblock long, dim int, block long")
    pairs = materialise(pairs, "admitted")
    sent = pairs.join(blocks, ["block", "dim"]).withColumn("slice", F.floor(F.col("block") / SLICE))

    def score(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({c: pd.Series(dtype="int64") for c in ("qblock", "n", "query_id", "vec_id", "score")})
        if not len(left) or not len(right):
            return empty
        dim = int(key[1])
        hi, lo = (np.stack([np.frombuffer(x, np.int64) for x in left[c]]) for c in ("hi", "lo"))
        ids = [np.frombuffer(x, np.int64) for x in left.ids]
        ms = [matrix(x, len(i), dim) for x, i in zip(left.m, ids, strict=True)]
        out = [empty]
        for r in right.itertuples():
            qids = np.frombuffer(r.qids, np.int64)
            q = matrix(r.qm, len(qids), dim)
            bounds, low = _bounds(q, hi, lo), floor_of(r, len(qids))
            exact = bool(np.abs(q).max(initial=0) < 1 << 20) and max((int(np.abs(m).max(initial=0)) for m in ms), default=0) < 1 << 20 and dim < 1 << 12
            qs, blocks_ = (q.astype(np.float64), [m.astype(np.float64) for m in ms]) if exact else (q, ms)
            for i in range(len(qids)):
                have_i, have_s, need = np.zeros(0, np.int64), np.zeros(0, np.int64), low[i]
                for b in np.argsort(-bounds[i], kind="stable"):
                    if bounds[i, b] < need:
                        break
                    other = ids[b] != qids[i]
                    have_i, have_s = _best(np.concatenate([have_s, (blocks_[b] @ qs[i]).astype(np.int64)[other]]), np.concatenate([have_i, ids[b][other]]), k)
                    if len(have_s) == k:
                        need = max(need, have_s[-1])
                out.append(pd.DataFrame({"qblock": r.wblock, "n": i, "query_id": np.full(len(have_i), qids[i]), "vec_id": have_i, "score": have_s}))
        return pd.concat(out)

    wanted = pairs.select(F.col("qblock").alias("wblock"), F.col("dim").alias("wdim"), F.floor(F.col("block") / SLICE).alias("wslice")).distinct()
    asking = ready.join(wanted, F.expr("qblock = wblock and dim = wdim")).drop("qblock", "dim")
    found = sent.groupBy("qblock", "dim", "slice").cogroup(asking.groupBy("wblock", "wdim", "wslice"))
    found = found.applyInPandas(score, "qblock long, n long, query_id long, vec_id long, score long")
    # a query row is its place in its block
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("qblock", "n", "query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").alias(id_col), "score")


def oracle_sql(k: int = 10, every: int = 100) -> str:
    """The same rows in DuckDB's SQL, from every pair of query and candidate."""
    return f"""
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {every} = 0)
        SELECT query_id, rank, vec_id, score FROM
            (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) r WHERE rank <= {k}"""
