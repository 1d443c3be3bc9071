"""Corpus pipeline over documents: STAGES in order, each written and read again.

Every stage takes nulls in any column, empty and very long texts, repeated rows
and empty tables, and passes the columns of documents on; what each does with
them is stated in the operator it calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidalframe.llm import bpe_segment_tree, byte_cnn, fuzzy_lines, simhash_golay, string_tiling
from tidalframe.llm._common import stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts and texts without a letter."""
    return byte_cnn.keep_identified(docs, byte_cnn.train(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one occurrence of each group of similar lines; a document that loses all its lines stays, empty."""
    return fuzzy_lines.drop_duplicate_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each SimHash component: smallest doc_id, then by hashes of the row; rows without an id come last."""
    return simhash_golay.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text covers a benchmark item; null and empty texts stay."""
    return string_tiling.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, a row each; null texts count as empty."""
    return bpe_segment_tree.digests(bpe_segment_tree.encode_decode(docs))


STAGES = [("identify_language", identify_language), ("dedup_lines", dedup_lines), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("tokenize", tokenize)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
