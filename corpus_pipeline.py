"""The corpus pipeline: quality rules, line deduplication, near deduplication, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as Parquet and
read back as the next one's docs. All but the last return the columns of documents. The last returns doc_id, n_tokens,
ids_sha256, decoded_sha256 and the ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from datakiln.llm import line_rules, line_templates, mixing, pieces, simhash
from datakiln.llm.common import DOCUMENT_COLUMNS, saved, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without boilerplate lines."""
    return line_rules.apply_rules(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of templates that recur across documents."""
    return line_templates.apply_templates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.without_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that a pass over the target mix takes."""
    return mixing.mixed(docs, table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, the end id included."""
    return pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), keep_ids=True)


STAGES = [
    ("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mix), ("sentencepiece", encode)
]

#: Hashes, fitted models and the encoder are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", *DOCUMENT_COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name, compression="zstd")
    return STAGES[-1][1](spark, docs, sf_dir)
