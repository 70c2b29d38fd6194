"""Demonstration queries of the corpus operators, over the given tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from matchframe.llm import (
    bloom_lm, codebooks, cotrain, decontaminate, fingerprints, mixing, near_dedup, passages, pseudonyms, ranked, secret_scan, topk, url_rules,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.scores(table(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked on sets of two-word shingles."""
    return near_dedup.classes(table(spark, sf_dir, "documents"), size=2)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), keep_columns=False)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs)


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeats(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.digest(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.digest(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_bloom_lm, op2_minhash_near_dedup, op3_source_mixing, op4_pseudonyms, op5_exact_top_k, op6_quality_classifier,
        op7_repeated_passages, op8_secret_scan, op9_benchmark_leaks, op10_url_rules, op11_ranked_search, op12_fingerprints, op13_vector_codes,
    )
} | {"pipeline": corpus_pipeline.run}
#: DuckDB twins, for the queries that SQL can express on whole tables.
ORACLES: dict[str, str] = {"op5_exact_top_k": topk.ORACLE, "op10_url_rules": url_rules.ORACLE, "op11_ranked_search": ranked.ORACLE, "op13_vector_codes": codebooks.ORACLE}
