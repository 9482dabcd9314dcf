"""The corpus pipeline: each stage takes (spark, docs, sf_dir), is written as Parquet and read again by the next.

Stages keep all columns, whatever their names, and stand nulls in any of them, empty and very long texts, repeated rows
and empty tables; what becomes of each is said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docforge.llm import bpe, decontaminate, language_id, pii, simhash_dedup
from docforge.llm.common import remove, scratch, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (null and empty texts too), or in none of the learned languages, go. Null ids and
    languages are no reason to go; repeated rows all stay."""
    return language_id.keep_known(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id stays of each group of near copies; of repeated rows one stays; a document without
    an id stays only where its group has no id."""
    return simhash_dedup.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; with an empty benchmark all stay."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span found is replaced by the name of its kind, and n_chars counted anew; a null text stays null."""
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens; a null text has no ids."""
    return bpe.encode_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("pii", redact_personal_data),
    ("bpe", encode),
]

#: Language models, fingerprints and BPE are nothing that SQL expresses; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
