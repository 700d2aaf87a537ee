"""The queries of the operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumeria.llm import alignment, bloom_lm, capdedup, chat, decontaminate, html_text, jaccard, langid, merkle, mixing, pii, repeats, toxicity
from plumeria.llm.frames import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.texts(table(spark, folder, "pages"))


def op2_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op3_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return capdedup.near_duplicates(table(spark, folder, "embeddings"))


def op4_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return bloom_lm.scores(table(spark, folder, "documents"))


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken(table(spark, folder, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, folder, "documents")).drop("class_id")


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    return chat.digests(table(spark, folder, "conversations"))


def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digests(table(spark, folder, "documents"))


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.predictions(table(spark, folder, "documents"))


def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.digests(table(spark, folder, "documents"))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.verified(table(spark, folder, "documents"))


def op13_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.digests(table(spark, folder, "documents"))


def queries() -> dict[str, Query]:
    found = (
        op1_html_extraction,
        op2_benchmark_decontamination,
        op3_embedding_near_dedup,
        op4_lm_scoring,
        op5_mixing,
        op6_ngram_jaccard_join,
        op7_toxicity,
        op8_chat_formatting,
        op9_pii,
        op10_language_id,
        op11_token_alignment,
        op12_merkle_manifest,
        op13_substring_dedup,
    )
    return {f.__name__: f for f in found}
