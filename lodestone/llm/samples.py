"""Held-out folds and bounded, repeatable samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int, part: int) -> Column:
    """Whether crc32 of the id, as text, falls into ``part`` modulo ``folds``; false for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == part, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, held: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``text, label`` of at most ``per_class`` documents of each label 0 and 1, outside ``held``.

    Which ones is decided by a hash of the id, so that the sample is the same in every
    run. A document with several label rows counts with the highest label; null labels
    are left out. The sample of ids is bounded and so may be broadcast; texts are read
    once.
    """
    own = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    if held is not None:
        own = own.where(~held)
    own = own.groupBy("id").agg(F.max("label").alias("label"))
    picks = [own.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(per_class) for k in (0, 1)]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picks[0].union(picks[1])), "id").select("text", "label")
