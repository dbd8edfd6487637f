"""A training corpus, stage by stage: each stage reads what the one before it wrote.

Every stage takes (spark, docs, sf_dir) and works on all of docs; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalforge.llm import byte_bpe, decontaminate, language_id, ngram_join, pii
from evalforge.llm.shared import materialise, tables

#: Texts whose language is predicted with a lower score are rejected, as are those without a letter.
LEAST_LANGUAGE_SCORE = 0.3


def _counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars as the text now is; a table without that column stays without it."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without a letter, or of no learned language's kind, go."""
    return language_id.accept(docs, language_id.fit(docs), LEAST_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.deduplicate(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that the benchmark has; no document goes."""
    return _counted(decontaminate.remove(docs, tables(spark, sf_dir, "benchmark"), window=10))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data and secrets replaced by their kinds; no document goes."""
    return _counted(pii.redact(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of each text's ids and of the bytes they decode to."""
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language_id", language), ("ngram_join", near_duplicates), ("decontaminate", benchmark), ("pii", personal_data), ("byte_bpe", tokens)]

#: Machines learned from data, hashes and BPE merges aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again."""
    docs = tables(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
