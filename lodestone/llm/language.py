"""Language identification by the nearest of several centroids per language.

A text is the vector of the byte 2- and 3-gram counts of its lower-cased letters, hashed into ``DIM``
buckets, dampened by log(1 + count), weighted by inverse document frequency and scaled to
length one. Each language has a few centroids from spherical clustering of labelled texts, made
in one task for each language; the model grows with the number of languages (80 KB each) only.
A text takes the language of the most similar centroid; one less similar than nearly all of
that centroid's own texts is marked rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.samples import fold
from lodestone.plans.stages import broadcast_if_small

DIM = 4096
#: Labelled texts of each language to cluster at most, and centroids of each language.
PER_LANGUAGE, CENTROIDS = 1500, 4
#: Share of a centroid's own texts that its rejection distance leaves out.
REJECT = 0.001
#: ASCII other than letters counts as a space, a run of them as one.
_FOLD = np.array([c if chr(c).isalpha() or c > 127 else 32 for c in range(256)], np.uint8)
_LETTER = re.compile(r"[^\W\d_]")


def _bags(texts: list[str | None]) -> np.ndarray:
    """Dampened n-gram counts, a row for each text."""
    out = np.zeros((len(texts), DIM), np.float32)
    for i, text in enumerate(texts):
        b = _FOLD[np.frombuffer((" " + (text or "").lower() + " ").encode("utf-8", "surrogatepass"), np.uint8)]
        b = b[1:][(b[1:] != 32) | (b[:-1] != 32)].astype(np.uint32)
        two = b[:-1] << 8 | b[1:]
        three = two[:-1] << 8 | b[2:]
        for grams, seed in ((two, 0x9E3779B1), (three, 0x85EBCA6B)):
            out[i] += np.bincount((grams * np.uint32(seed)) >> np.uint32(20), minlength=DIM)
    return np.log1p(out, out=out)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many non-empty texts of ``docs`` each bucket occurs, over all of them, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIM + 1, np.int64)
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            for k in range(0, len(texts), 256):
                total[:DIM] += (_bags(texts[k : k + 256]) > 0).sum(0)
            total[DIM] += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIM + 1)), pa.array(total)], ["bucket", "n"])

    got = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(DIM + 1, np.int64)
    n[got.bucket] = got.n
    return n[:DIM], int(n[DIM])


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    least: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, similarities between 0 and 1, and rejections of a few texts."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        near = _unit(_bags(texts) * self.idf) @ self.centroids.T
        best = near.argmax(1)
        score = np.clip(near[np.arange(len(texts)), best].astype(np.float64), 0, 1)
        none = np.array([not t or not _LETTER.search(t) for t in texts], bool)
        names = ["und" if x else self.languages[k] for x, k in zip(none, best, strict=True)]
        return names, np.where(none, 0.0, score), none | (score < self.least[best])


def _cluster(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means, started from rows far from each other: unit centroids, and each row's centroid."""
    k = min(k, len(x))
    centers = [x[0]]
    for _ in range(k - 1):  # the row that is farthest from the ones taken
        centers.append(x[np.argmin((x @ np.array(centers).T).max(1))])
    c = np.array(centers)
    for _ in range(12):
        own = (x @ c.T).argmax(1)
        c = _unit(np.array([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(k)]))
    return c, (x @ c.T).argmax(1)


def train(docs: DataFrame, folds: int, part: int) -> Model:
    """The model from text and non-null lang of documents outside the held-out fold.

    Document frequencies are counted over all those texts that have a letter; centroids come from
    ``PER_LANGUAGE`` of each language at most, those with the smallest hashes of id and text.
    """
    own = docs.select("doc_id", "text", "lang").where(~fold("doc_id", folds, part) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    df, n = document_frequency(own)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(0.01)
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit(6)), F.lit(1 << 40))
    # a share of each language's texts that holds enough of them, then the smallest hashes: no task ranks a whole language
    share = own.groupBy("lang").agg(F.count("*").alias("n")).select("lang", F.least(F.lit(1.0), (2.0 * PER_LANGUAGE + 200) / F.col("n")).alias("share"))
    pick = own.withColumn("place", place).join(broadcast_if_small(share), "lang").where(F.col("place") < F.col("share") * (1 << 40))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))
    pick = pick.select("lang", "place", "doc_id", "text").withColumn("rank", rank).where(F.col("rank") <= PER_LANGUAGE)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                some = batch.slice(k, 256)
                x = _unit(_bags(some.column(2).to_pylist()) * idf)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "rank", "x"])

    def cluster(part_: pa.Table) -> pa.Table:
        order = np.argsort(part_.column("rank").to_numpy(), kind="stable")
        x = np.stack([np.frombuffer(r.as_buffer(), np.float32) for r in part_.column("x")])[order]
        c, at = _cluster(x, CENTROIDS)
        near = (x * c[at]).sum(1)
        least = [float(np.quantile(near[at == j], REJECT)) if (at == j).any() else 0.0 for j in range(len(c))]
        return pa.table({"lang": pa.array([part_.column("lang")[0].as_py()] * len(c), pa.string()), "j": pa.array(range(len(c)), pa.int32()), "c": pa.array([r.astype(np.float32).tobytes() for r in c], pa.binary()), "least": pa.array(least)})

    found = pick.select("lang", "rank", "text").mapInArrow(bags, "lang string, rank int, x binary").groupBy("lang").applyInArrow(cluster, "lang string, j int, c binary, least double")
    rows = sorted(found.collect(), key=lambda r: (r.lang, r.j))  # CENTROIDS rows for each language
    centroids = np.stack([np.frombuffer(r.c, np.float32) for r in rows]) if rows else np.zeros((0, DIM), np.float32)
    return Model(idf, centroids, [r.lang for r in rows], np.array([r.least for r in rows]))


def identify(docs: DataFrame, folds: int = 4, part: int = 2) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` for every document.

    lang_pred is a learned language, or ``und`` where the text is null or has no letter
    (score 0). The score is the similarity to the nearest centroid. Documents without a
    language, with a null id or repeated are predicted alike; if no language can be
    learned, all are ``und``.
    """
    model = train(docs, folds, part)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                some = batch.slice(k, 256)
                names, score, rejected = model.predict(some.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], ["id", "lang_pred", "score", "rejected"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"id {id_type}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", "doc_id")
    return out.select("doc_id", fold("doc_id", folds, part).alias("held_out"), "lang_pred", "score", "rejected")
