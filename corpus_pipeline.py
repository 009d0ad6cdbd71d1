"""From raw documents to token ids: the stages of a training corpus, each calling one operator of the corpus part.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents, whatever further ones there are and however they
are called; repeated rows and rows with NULL ids are rows like others, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from screenspark.llm import bpe, decontaminate, language, quality, simhash
from screenspark.llm.common import drop_scratch, table
from screenspark.session import scratch_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay; NULL and empty texts and those without a letter go."""
    return language.accepted(docs)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not find bad stay; NULL texts are judged as empty ones."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest id, NULL ids last; texts without words are
    duplicates of each other."""
    return simhash.one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage stay; NULL and empty texts hold none."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and checksums of the ids and of the text decoded from them; NULL texts are empty ones."""
    return bpe.round_trip(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_filter),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("bpe_encoding_and_decoding", tokens),
]

#: SQL has no suffix automata, factorisation machines or BPE: tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents of a folder. A stage's table is removed when the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            drop_scratch(spark, before)
        before = path
    return docs
