"""The queries that apply the operators to the whole generated tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlens.llm import (
    byte_bpe,
    conversations,
    filter_audit,
    fingerprints,
    lines,
    mixing,
    near_dups,
    pii,
    quality,
    quality_net,
    scoring,
    token_counts,
    toxicity,
)

PIECES = "piece_bpe_32k.model"
RANKS = "byte_bpe_50k.tiktoken"

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.judged(documents(spark, folder), "doc_id")


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(documents(spark, folder))


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.counted(documents(spark, folder), public_tokenizers.path(PIECES), "doc_id")


def op4_near_dups(spark: SparkSession, folder: str) -> DataFrame:
    return near_dups.grouped(documents(spark, folder).select("doc_id", "text"))


def op5_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprinted(documents(spark, folder))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(documents(spark, folder).select("doc_id", "text", "lang"), "doc_id").drop("lang")


def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe.digests(documents(spark, folder), public_tokenizers.path(RANKS), "doc_id")


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.judged(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.found(documents(spark, folder), "doc_id")


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    deduped = lines.deduped(documents(spark, folder).select("doc_id", "text"))
    return deduped.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audited(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


def op12_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_net.judged(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.repaired(conversations.damaged(spark.read.parquet(f"{folder}/conversations.parquet")))


QUERIES: dict[str, Query] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_mixing": op2_mixing,
    "op3_token_counts": op3_token_counts,
    "op4_near_dups": op4_near_dups,
    "op5_fingerprints": op5_fingerprints,
    "op6_quality": op6_quality,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_toxicity": op8_toxicity,
    "op9_pii": op9_pii,
    "op10_line_dedup": op10_line_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_quality_classifier": op12_quality_classifier,
    "op13_conversation_repair": op13_conversation_repair,
    "pipeline": corpus_pipeline.run,
}
