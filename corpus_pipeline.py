"""A corpus from raw documents: language, near duplicates, benchmark leaks, personal data, mixture."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from trackweave.llm import decontaminate, jaccard, language, mixing, pii
from trackweave.llm.common import shared_dir, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language."""
    return language.with_known_language(docs)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group of five-word shingle sets that link at a similarity of 0.8."""
    return jaccard.first_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def privacy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data as pseudonyms; n_chars follows the text."""
    out = pii.pseudonymise(docs)
    return out.withColumn("n_chars", F.when(F.col("n_pii") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(docs.columns)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, domain, lang, source, tokens, copies, text and n_chars of the documents that the mixture takes: the corpus."""
    return mixing.mix(docs, keep=("text", "n_chars"))


STAGES = [("language", language_stage), ("near_duplicates", duplicate_stage), ("decontamination", benchmark_stage), ("pii", privacy_stage), ("mixing", mixture_stage)]

#: No SQL for language models, shingle links and leaks; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus: what the last stage wrote, texts included. Each stage's table stays in the folder of its own run, under the shared one."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
