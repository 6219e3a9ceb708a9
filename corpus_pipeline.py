"""A training corpus from raw documents: five stages, each a DataFrame from the one before.

Every stage is a function of (spark, docs, sf_dir); its result is written as Parquet and
read again as the next one's documents.
"""

from __future__ import annotations

from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlens.llm import byte_bpe, lines, mixing, near_dups, quality
from fleetlens.session import ensure_checkpoint_dir

RANKS = "byte_bpe_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the plain rules or are far from their language go."""
    return quality.kept(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents lose the lines that many of them share; none goes."""
    kept = lines.deduped(docs).withColumn("text", F.col("kept_text"))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id."""
    return near_dups.deduped(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, not at all, once or twice."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, the token ids, their number, and digests of ids and decoded bytes."""
    return byte_bpe.encoded_with_digests(docs, public_tokenizers.path(RANKS), "doc_id", "source")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("mixing", mix),
    ("byte-level BPE", tokens),
]

# Hash signatures, distances and token ids have no SQL form; the tests hold the stages
# against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder of tables."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
