"""The corpus operators as queries on the given tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from screenspark.llm import alignment, bpe, decontaminate, embedding_links, html_content, language, quality, runs, sharding, simhash, sketches, token_files, url_filter
from screenspark.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


@query("op1_sharding")
def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.sharded_documents(table(spark, folder, "documents"))


@query("op4_simhash_near_dedup")
def op4_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.linked_documents(table(spark, folder, "documents"))


@query("op7_benchmark_decontamination", decontaminate.ORACLE)
def op7_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op5_embedding_near_dedup", embedding_links.ORACLE)
def op5_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_links.vector_components(table(spark, folder, "embeddings"))


@query("op8_bpe_encoding_and_decoding")
def op8_bpe_encoding_and_decoding(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"))


@query("op6_token_id_binary_output")
def op6_token_id_binary_output(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.through_file(table(spark, folder, "documents"))


@query("op9_language_id")
def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.document_languages(table(spark, folder, "documents"))


@query("op10_quality_classifier")
def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.document_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op2_url_filters")
def op2_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.page_verdicts(table(spark, folder, "pages"))


@query("op3_html_extraction")
def op3_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_content.page_texts(table(spark, folder, "pages"))


@query("op11_periodic_run_detection")
def op11_periodic_run_detection(spark: SparkSession, folder: str) -> DataFrame:
    return runs.document_runs(table(spark, folder, "documents"))


@query("op12_cross_tokenizer_alignment")
def op12_cross_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.document_alignments(table(spark, folder, "documents"))


@query("op13_document_fingerprints")
def op13_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return sketches.document_fingerprints(table(spark, folder, "documents"))
