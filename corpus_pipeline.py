"""A training corpus from ``documents``: five stages, each over all that its predecessor kept.

Every stage but the last returns the columns it got. Null texts have no words and fall at the first
stage; repeated rows stay repeated; an empty table gives an empty result; further columns pass through,
whatever their names, up to the last stage, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from signalkiln.llm import decontaminate, line_dedup, near_dup, quality_rules, sp_codec
from signalkiln.llm.common import Scratch
from signalkiln.llm.queries import tokenizer_model


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the base rules or the learned decision list reject."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop long lines that five documents or more hold, except in the largest doc_id; texts change, no row goes."""
    return line_dedup.drop_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the least doc_id of each component of texts that are alike in 80 of 100 five-word shingles; rows without an id stay."""
    return near_dup.deduplicate(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, whole or edited; rows without an id stay."""
    return decontaminate.drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, counts and digests, ids and decoded text of each document."""
    return sp_codec.encode(docs, tokenizer_model(), with_ids=True)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontamination", decontamination), ("sentencepiece", encoding)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each result written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
