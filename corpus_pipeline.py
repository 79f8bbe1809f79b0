"""The corpus pipeline: five stages, each over all that its predecessor kept.

Every stage is a function of (spark, docs, sf_dir). Its result is written as Parquet and read again as the
next stage's docs. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import staged
from quantloom.llm.mixing import mix_documents, repeat_documents
from quantloom.llm.near_dup import near_duplicates
from quantloom.llm.quality_classifier import classify
from quantloom.llm.secret_scan import redact_secrets
from quantloom.llm.sentencepiece_lattice import Pieces, encode

#: The stages run Python models and trained weights, which SQL cannot express; tests hold them against
#: brute-force versions.
ORACLE_SQL = None

#: Words of a shingle in stages without a contract of their own (op5's own contract has four).
SHINGLE = 5


#: A row's key: 128 bits of its whole content, as null or repeated doc_ids do not name a row. Rows of equal keys
#: are equal, so decisions on them are too.
KEY = ("row_key1", "row_key2")


def _keyed(docs: DataFrame) -> DataFrame:
    content = [x for c in docs.columns for x in (F.col(c), F.isnull(c))]
    return docs.select("*", *[F.xxhash64(F.lit(i), *content).alias(k) for i, k in enumerate(KEY)])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier rejects go (empty and toxic texts among them)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    keyed = _keyed(docs)
    kept = classify(keyed, labels, keep=KEY).where("kept").select(*KEY).distinct()
    return keyed.join(kept, list(KEY), "left_semi").select(*docs.columns)


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: that of the smallest doc_id (null last), then key. Near are
    texts whose sets of SHINGLE words have similarity 0.8; rows are compared under numbers of their own."""
    rows = staged(_keyed(docs).withColumn("row_number", F.monotonically_increasing_id()), "rows")
    groups = near_duplicates(rows.select(F.col("row_number").alias("doc_id"), "text"), size=SHINGLE).select(F.col("doc_id").alias("row_number"), "component_id")
    first = F.min(F.struct(F.isnull("doc_id"), "doc_id", *KEY, "row_number")).alias("first")
    kept = groups.join(rows.select("row_number", "doc_id", *KEY), "row_number").groupBy("component_id").agg(first).select("first.row_number")
    return rows.join(kept, "row_number", "left_semi").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by their kind; n_chars follows."""
    return redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents appear as often as the mix takes them, to the nearest whole copy."""
    keyed = _keyed(docs)
    return repeat_documents(keyed, mix_documents(keyed, keep=KEY), KEY).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the ids of the text's pieces; a repeated document repeats its row."""
    return encode(docs, Pieces()).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality classifier", quality), ("near-duplicates", near_dups), ("secrets", secrets), ("mix", mix), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"pipeline{k}")
    return docs
