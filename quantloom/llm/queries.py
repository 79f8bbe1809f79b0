"""Queries of the training-data operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quantloom.llm import oracles
from quantloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op1_substring_dedup": oracles.OP1, "op2_host_quality_rules": oracles.OP2, "op3_mix_sources": oracles.OP3, "op5_minhash_near_dup": oracles.OP5, "op12_lloyd_clusters": oracles.OP12}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op2_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


@query
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.mixing import mix_documents

    return mix_documents(table(spark, sf_dir, "documents"))


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.secret_scan import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


@query
def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.html_extract import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


@query
def op5_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.quality_classifier import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.substring_dedup import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents"))


@query
def op10_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.hmm_lm import hmm_scores

    return hmm_scores(table(spark, sf_dir, "documents"))


@query
def op8_sentencepiece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.sentencepiece_lattice import encode_and_decode

    return encode_and_decode(table(spark, sf_dir, "documents"))


@query
def op7_multiprobe_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.ann_lsh import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


@query
def op11_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.weighted_fingerprints import fingerprint_documents

    return fingerprint_documents(table(spark, sf_dir, "documents"))


@query
def op12_lloyd_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.centroids import cluster_vectors

    return cluster_vectors(table(spark, sf_dir, "embeddings"))


@query
def op13_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))
