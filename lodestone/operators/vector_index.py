"""A stored inverted file for vector search: built once, read by partition, as large as the data asks for.

``build`` writes below one path:

* ``centres``: about as many cells as the root of the number of vectors, in two layers. The centres of the
  first layer, about the fourth root, are fitted on a sample of :data:`SAMPLE` vectors each on the driver; those of the second, inside each
  first cell and as many as its share asks for, in one task a cell on its part of a sample of :data:`SAMPLE` vectors a cell.
* ``vectors``: every vector in its cell, one folder for each first cell, sorted by cell, as the rest to its centre in one
  byte a number (``code``, ``scale``) and whole.
* ``about``: the number of vectors, cells, and cells to look into.

``search`` reads the folders that some query looks into, scores codes, and takes the best of
these for exact cosines, for which whole vectors of the candidates' cells are read. A query meets a first cell once, with all its cells there that are
looked into, and large first cells are dealt over several groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import cosine
from lodestone.operators.search import _usable, knn
from lodestone.plans.stages import materialise

#: Vectors of a sample for each centre, rounds of k-means, and the share of true neighbours that ``build`` looks for.
SAMPLE, ROUNDS, RECALL = 64, 10, 0.97
#: Vectors of one group, and queries of one; groups of one task; candidates for exact scores, for each of the k.
ROWS, ASKED, GROUPS, MORE = 4096, 1024, 16, 4


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def fit(v: np.ndarray, k: int) -> np.ndarray:
    """At most k centres of length one of unit vectors, by spherical k-means that starts from far points."""
    v = v[np.abs(v).sum(1) > 0]
    if not len(v):
        return np.zeros((1, v.shape[1]))
    k, picked = min(k, len(v)), [0]
    near = v @ v[0]
    while len(picked) < k:
        at = int(near.argmin())
        if near[at] > 1 - 1e-9:
            break  # all others are copies of picked ones
        picked.append(at)
        near = np.maximum(near, v @ v[at])
    centres = v[picked]
    for _ in range(ROUNDS):
        own = (v @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, v)
        some = np.abs(sums).sum(1) > 0
        centres = np.where(some[:, None], _unit(sums), centres)
    return centres


def _first(rows: DataFrame, coarse: np.ndarray, width: int) -> DataFrame:
    """``rows`` (with ``v``) once for each of their ``width`` nearest first cells."""

    @F.pandas_udf("array<int>")
    def nearest(x):
        import pandas as pd

        near = np.argsort(-(_unit(np.stack(x.to_list())) @ coarse.T), axis=1, kind="stable")[:, :width]
        return pd.Series(list(near.astype("int32")))

    return rows.withColumn("coarse", F.explode(nearest("v")))


def _cells(rows: DataFrame, key: str, count: int, centres: DataFrame, coarse: np.ndarray, width: int, most: int) -> DataFrame:
    """``key, v, coarse, cell, base``: the ``most`` nearest cells in each of a row's nearest first cells; ``base`` is the cosine with the centre.

    Rows of a first cell are dealt over as many groups as the count of all rows asks for, and each group gets the cell's centres.
    """
    deal = max(1, -(-count // ROWS))
    kind = rows.schema[key].dataType.simpleString()

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({key: pa.array([], left.schema.field(key).type), "v": pa.array([], pa.list_(pa.float64())), **{c: pa.array([], t) for c, t in (("coarse", pa.int32()), ("cell", pa.int32()), ("base", pa.float64()))}})
        v, c = _unit(_matrix(left.column("v"))), _matrix(right.column("centre"))
        same = v @ c.T
        best = np.argsort(-same, axis=1, kind="stable")[:, :most]
        at = pa.array(np.repeat(np.arange(len(v)), best.shape[1]))
        return pa.table({key: left.column(key).take(at), "v": left.column("v").take(at), "coarse": left.column("coarse").take(at), "cell": right.column("cell").combine_chunks().take(pa.array(best.ravel())), "base": pa.array(np.take_along_axis(same, best, 1).ravel())})

    left = _first(rows.select(key, "v"), coarse, width).withColumn("deal", F.pmod(F.xxhash64(key, "v"), F.lit(deal)))
    right = centres.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deal - 1).cast("long"))))
    return left.groupBy("coarse", "deal").cogroup(right.groupBy("coarse", "deal")).applyInArrow(place, f"{key} {kind}, v array<double>, coarse int, cell int, base double")


def _probed(queries: DataFrame, count: int, centres: DataFrame, probes: int) -> DataFrame:
    """``query_id, v, coarse, cells, bases``: the ``probes`` nearest of all cells of each query, a row for each first cell that has some of them.

    Queries are dealt into blocks, each of which gets all centres (the root of the vectors) at once, so a query is never shuffled for each cell.
    """
    deal = max(1, -(-count // ASKED))
    kind = queries.schema["query_id"].dataType.simpleString()

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        types = {"query_id": left.schema.field("query_id").type, "v": pa.list_(pa.float64()), "coarse": pa.int32(), "cells": pa.list_(pa.int32()), "bases": pa.list_(pa.float64())}
        if not len(left) or not len(right):
            return pa.table({c: pa.array([], t) for c, t in types.items()})
        right = right.sort_by([("coarse", "ascending"), ("cell", "ascending")])
        v, coarse, cell = _unit(_matrix(left.column("v"))), right.column("coarse").to_numpy(), right.column("cell").to_numpy()
        same = v @ _matrix(right.column("centre")).T
        best = np.sort(np.argsort(-same, axis=1, kind="stable")[:, :probes], axis=1)  # back in the order of first cells
        row, best = np.repeat(np.arange(len(v)), best.shape[1]), best.ravel()
        first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (coarse[best[1:]] != coarse[best[:-1]])])
        ends = pa.array(np.r_[first, len(row)], pa.int32())
        at = pa.array(row[first])
        return pa.table({"query_id": left.column("query_id").take(at), "v": left.column("v").take(at), "coarse": pa.array(coarse[best[first]], pa.int32()), "cells": pa.ListArray.from_arrays(ends, pa.array(cell[best], pa.int32())), "bases": pa.ListArray.from_arrays(ends, pa.array(same[row, best]))})

    left = queries.select("query_id", "v").withColumn("deal", F.pmod(F.xxhash64("query_id", "v"), F.lit(deal)))
    right = centres.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deal - 1).cast("long"))))
    return left.groupBy("deal").cogroup(right.groupBy("deal")).applyInArrow(place, f"query_id {kind}, v array<double>, coarse int, cells array<int>, bases array<double>")


def build(vectors: DataFrame, path: str, cells: int | None = None, recall: float = RECALL, k: int = 10) -> None:
    """Write the index of ``vectors`` (``id, vector``, all of one length) below ``path``.

    ``cells`` is the root of the number of vectors by default. How many cells a query looks into comes from about
    64 vectors, whose k true neighbours are found exactly: so many cells hold ``recall`` of them. Vectors that are null,
    empty or hold null or infinite numbers are left out; vectors of zeros are in some cell.
    """
    spark = vectors.sparkSession
    v = materialise(_usable(vectors, "id"), "vectors")
    n, kind = v.count(), v.schema["id"].dataType.simpleString()
    about = lambda cells, probes: spark.createDataFrame([(n, cells, probes, kind)], "vectors long, cells long, probes int, id_type string").write.mode("overwrite").parquet(f"{path}/about")
    if not n:
        return about(0, 0)
    cells = cells or max(1, int(n**0.5))
    share = lambda rows: F.pmod(F.xxhash64("id", "v"), F.lit(max(n, 1))) < rows
    top = max(1, round(cells**0.5))
    sample = v.where(share(SAMPLE * top)).select("v").toPandas()
    coarse = fit(_unit(np.stack(sample["v"].to_list())), top)

    def inner(table: pa.Table) -> pa.Table:
        own = fit(_unit(_matrix(table.column("v"))), max(1, round(len(table) / SAMPLE)))
        return pa.table({"coarse": pa.array([table.column("coarse")[0].as_py()] * len(own), pa.int32()), "cell": pa.array(range(len(own)), pa.int32()), "centre": pa.array(list(own))})

    some = _first(v.where(share(SAMPLE * cells)).select("v"), coarse, 1)
    given = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(coarse)], "coarse int, centre array<double>")
    found = materialise(some.groupBy("coarse").applyInArrow(inner, "coarse int, cell int, centre array<double>"), "centres")
    # a first cell that the sample has no vector of is one cell
    bare = given.join(found.select("coarse").distinct(), "coarse", "left_anti").select("coarse", F.lit(0).alias("cell"), "centre")
    centres = found.union(bare)
    centres.write.mode("overwrite").parquet(f"{path}/centres")
    centres = spark.read.parquet(f"{path}/centres")
    given.write.mode("overwrite").parquet(f"{path}/coarse")

    placed = _cells(v, "id", n, centres, coarse, 1, 1).withColumnRenamed("base", "near").join(centres, ["coarse", "cell"])
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rest = F.zip_with("v", "centre", lambda x, c: F.when(size > 0, x / size).otherwise(0.0) - c)
    placed = placed.withColumn("rest", rest).withColumn("scale", F.greatest(F.array_max(F.transform("rest", F.abs)), F.lit(1e-12)) / 127)
    code = F.transform("rest", lambda x: F.round(x / F.col("scale")).cast("tinyint"))
    placed = placed.select("id", "cell", code.alias("code"), F.col("scale").cast("float"), F.col("v").alias("vector"), "coarse")
    # a large first cell is written by several tasks
    deal = F.pmod(F.xxhash64("id", "vector"), F.lit(max(1, -(-n // (64 * ROWS)))))
    placed.repartition("coarse", deal).sortWithinPartitions("coarse", "cell").write.mode("overwrite").partitionBy("coarse").parquet(f"{path}/vectors")

    tried = v.where(share(SAMPLE)).select(F.col("id").alias("query_id"), F.col("v").alias("vector"))
    true = knn(tried, v.select("id", F.col("v").alias("vector")), k).join(spark.read.parquet(f"{path}/vectors").select("id", "coarse", "cell"), "id")
    order = _cells(tried.select("query_id", F.col("vector").alias("v")), "query_id", SAMPLE, centres, coarse, len(coarse), 1 << 30)
    order = order.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("base"), "coarse", "cell")))
    at = true.join(order.drop("v"), ["query_id", "coarse", "cell"]).select(F.percentile("at", F.lit(recall))).first()[0]
    probes, whole = int(np.ceil(at)) if at else 1, centres.count()
    about(whole, probes)


def search(queries: DataFrame, path: str, k: int, probes: int | None = None) -> DataFrame:
    """``query_id, id, score, rank`` by exact cosine of the k best by codes among the nearest ``probes`` cells.

    ``queries`` has ``query_id, vector``; those without a usable vector have no hits. Ties go to the smaller id.
    """
    spark = queries.sparkSession
    about = spark.read.parquet(f"{path}/about").first()
    if not about["vectors"]:
        return queries.limit(0).select("query_id", F.lit(None).cast(about["id_type"]).alias("id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
    centres = spark.read.parquet(f"{path}/centres")
    probes = probes or about["probes"]
    q = materialise(_usable(queries, "query_id"), "queries")
    asked, most = q.count(), MORE * k
    near = materialise(_probed(q, asked, centres, probes), "probed")
    folders = [r[0] for r in near.select("coarse").distinct().collect()]
    stored = spark.read.parquet(f"{path}/vectors").where(F.col("coarse").isin(folders))
    # so many groups for a first cell as its vectors and its queries ask for, both counted
    held = near.groupBy("coarse").agg(F.count("*").alias("m")).join(stored.groupBy("coarse").agg(F.count("*").alias("n")), "coarse")
    held = materialise(held.select("coarse", F.ceil(F.col("m") / ASKED).alias("qs"), F.ceil(F.col("n") / ROWS).alias("vs")), "held")
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = near.join(F.broadcast(held), "coarse").withColumn("qb", F.pmod(F.xxhash64("query_id", "v"), "qs")).withColumn("vb", every("vs")).select("query_id", "v", "cells", "bases", "coarse", "qb", "vb")
    right = stored.select("id", "code", "scale", "coarse", "cell").join(F.broadcast(held), "coarse").withColumn("vb", F.pmod(F.xxhash64("id", "code"), "vs")).withColumn("qb", every("qs")).select("id", "code", "scale", "coarse", "cell", "qb", "vb")
    kinds = {f.name: f.dataType.simpleString() for f in [*q.schema, *stored.schema]}
    keys = ["coarse", "qb", "vb"]
    # a task gets a few groups, however many there are
    groups = held.agg(F.sum(F.col("qs") * F.col("vs"))).first()[0] or 0
    if groups // GROUPS > int(spark.conf.get("spark.sql.shuffle.partitions")):
        left, right = left.repartition(groups // GROUPS, *keys), right.repartition(groups // GROUPS, *keys)

    def block(a: pa.Table, b: pa.Table) -> pa.Table:
        types = {"query_id": a.schema.field("query_id").type, "id": b.schema.field("id").type, "coarse": pa.int32(), "score": pa.float64()}
        if not len(a) or not len(b):
            return pa.table({c: pa.array([], t) for c, t in types.items()})
        b = b.sort_by("id")  # equal scores then go to the smaller id
        v, code, scale, own = _unit(_matrix(a.column("v"))), _matrix(b.column("code")).astype(np.float64), b.column("scale").to_numpy(), b.column("cell").to_numpy()
        cells, bases = (a.column(c).combine_chunks() for c in ("cells", "bases"))
        asking = np.repeat(np.arange(len(a)), cells.value_lengths().to_numpy(zero_copy_only=False))
        cells, bases = cells.flatten().to_numpy(), bases.flatten().to_numpy()
        score = np.full((len(a), len(b)), -np.inf)
        for cell in np.intersect1d(cells, own):
            at, held = np.flatnonzero(cells == cell), np.flatnonzero(own == cell)
            score[np.ix_(asking[at], held)] = bases[at][:, None] + (v[asking[at]] @ code[held].T) * scale[held]
        least = np.partition(score, -most, axis=1)[:, -most] if len(b) > most else np.full(len(a), -np.inf)
        row, col = np.nonzero((score >= least[:, None]) & (score > -np.inf))
        score = score[row, col]
        order = np.lexsort((col, -score, row))
        row, col, score = row[order], col[order], score[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < most
        row, col, score = row[kept], col[kept], score[kept]
        return pa.table({"query_id": a.column("query_id").take(pa.array(row)), "id": b.column("id").take(pa.array(col)), "coarse": pa.array(np.full(len(row), a.column("coarse")[0].as_py()), pa.int32()), "score": pa.array(score)})

    rough = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(block, f"query_id {kinds['query_id']}, id {kinds['id']}, coarse int, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    rough = materialise(rough.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("query_id", "id", "coarse"), "rough")
    exact = stored.select("id", "coarse", "vector").join(rough, ["id", "coarse"]).join(q.withColumnRenamed("v", "q"), "query_id")
    exact = exact.select("query_id", "id", F.round(cosine(F.col("q"), F.col("vector")), 6).alias("score"))
    return exact.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def stored(vectors: DataFrame, path: str) -> str:
    """``path``, with the index of ``vectors`` below it, which is built unless it is there already."""
    spark: SparkSession = vectors.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/about/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        build(vectors, path)
    return path
