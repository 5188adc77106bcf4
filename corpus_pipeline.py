"""From raw documents to encoded ones: the stages of a training corpus, each over all that the one before kept.

All but the last stage return the columns of documents, whatever else the table holds. Rows that share a doc_id, or have
none, are told apart by their texts; repeated rows share their fate until near_dedup leaves one of them. Each stage gives
an empty table for an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessel.llm import byte_bpe, decontaminate, line_dedup, near_dup, quality_rules
from tessel.llm.common import drop, read, written
from tessel.session import ship


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the quality rules reject. Null, empty and short texts go; a null language or source is a group like any other."""
    return quality_rules.keep_good(docs)


def unlike_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with each group of like lines cut to its first, and without those that lose all lines with words. Null and empty texts stay as they are."""
    ship(spark)
    return line_dedup.drop_duplicate_lines(docs)


def unlike_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one document of each group of near-duplicates, that of the least doc_id (null first). Documents without text link with nothing and stay."""
    ship(spark)
    return near_dup.drop_near_duplicates(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that overlap an item of the benchmark. Null and empty texts and items overlap nothing."""
    return decontaminate.drop_overlapping(docs, read(ship(spark), sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document; a null text is encoded as an empty one."""
    ship(spark)
    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", good_quality),
    ("line_dedup", unlike_lines),
    ("near_dedup", unlike_documents),
    ("decontaminate", clean_of_benchmark),
    ("byte_bpe", encoded),
]

#: Line and document similarity are not for SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document that all stages keep. A stage's table goes once the next is written."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage_{name}")
        if before:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
