"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontam, infill, licenses, repair, topk
from lodestone.plans.stages import table


def bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.toxicity import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.substrings import kept_digests

    return kept_digests(table(spark, sf_dir, "documents"))


def op3_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.maxent import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.language import identify

    return identify(table(spark, sf_dir, "documents"))


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.bpe import token_digests

    return token_digests(table(spark, sf_dir, "documents"), bpe_path())


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_damaged(table(spark, sf_dir, "conversations"))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.pieces import token_digests

    return token_digests(table(spark, sf_dir, "documents"), pieces_path())


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_substrings": op2_substrings,
    "op3_maxent": op3_maxent,
    "op4_decontamination": op4_decontamination,
    "op5_licenses": op5_licenses,
    "op6_language": op6_language,
    "op7_neardup": op7_neardup,
    "op8_bpe": op8_bpe,
    "op9_quality": op9_quality,
    "op10_topk": op10_topk,
    "op11_repair": op11_repair,
    "op12_pieces": op12_pieces,
    "op13_infill": op13_infill,
}
ORACLE_SQL: dict[str, str] = {
    "op4_decontamination": decontam.oracle_sql(),
    "op5_licenses": licenses.oracle_sql(),
    "op10_topk": topk.oracle_sql(),
    "op11_repair": repair.oracle_sql(),
    "op13_infill": infill.oracle_sql(),
}
