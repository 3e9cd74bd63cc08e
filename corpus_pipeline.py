"""The training-corpus pipeline: five stages from raw documents to token ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return
the columns of ``documents``. A stage's result is written as Parquet into the shared folder
and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontam, neardup, quality, substrings
from lodestone.llm.queries import bpe_path
from lodestone.plans.stages import materialise, table


#: Rows of an Arrow batch: texts are long, and two batches of each task are held at a time.
BATCHES, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def _small_batches(spark: SparkSession) -> None:
    """Set for the session: a stage's tasks run only when its caller writes it. :func:`run` puts it back."""
    spark.conf.set(BATCHES, BATCH_ROWS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts."""
    _small_batches(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group; documents without an id are in none and stay."""
    _small_batches(spark)
    gone = neardup.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that start earlier elsewhere; those with nothing else go.

    A document that loses words has its other words joined by single spaces, and n_chars
    follows; any other stays as it is, as do documents without an id. Rows of one id with different texts are told apart by their text.
    """
    _small_batches(spark)
    left, tag = "left", "tag"
    while {left, tag} & set(docs.columns):  # documents may have any further columns
        left, tag = left + "_", tag + "_"
    cut = substrings.drop_repeats(docs).where("n_removed > 0").select("doc_id", F.col("tag").alias(tag), F.col("kept").alias(left)).distinct()
    docs_ = docs.withColumn(tag, F.xxhash64("text"))
    out = docs_.join(materialise(cut, "cut").hint("merge"), ["doc_id", tag], "left").where(F.col(left).isNull() | (F.col(left) != ""))
    out = out.withColumn("n_chars", F.when(F.col(left).isNull(), F.col("n_chars")).otherwise(F.length(left)).cast(docs.schema["n_chars"].dataType))
    return out.withColumn("text", F.coalesce(left, "text")).select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; rows of one id go together, and those without an id stay."""
    leaks = decontam.contained_items(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks.hint("merge"), "doc_id", "left_anti").select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens, and digests of ids and decoded text, of each document."""
    _small_batches(spark)
    return bpe.token_digests(docs, bpe_path())


STAGES = [
    ("quality", good_quality),
    ("near_dedup", one_of_each),
    ("substring_dedup", without_repeats),
    ("decontamination", without_benchmark),
    ("bpe", token_ids),
]

#: The classifier cannot be expressed in SQL; the tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the table ``documents``; the session's setting is put back."""
    docs, before = table(spark, sf_dir, "documents"), spark.conf.get(BATCHES)
    try:
        for name, stage in STAGES:
            docs = materialise(stage(spark, docs, sf_dir), name)
    finally:
        spark.conf.set(BATCHES, before)
    return docs
