"""A corpus pipeline: toxic documents go, copies and near copies go, secrets are blotted out, the rest is packed.

Stages keep all columns, whatever their names. Null and empty texts are never toxic, are equal to
each other and so fall to one row in the second stage, have no near copies and no secrets, and pack as one token.
Rows that repeat an id are dealt with one by one, but in the third stage, where they stay or go
together. Ties go to the smallest id. A text of any length is read whole in every stage. An empty table
stays empty. ``documents`` has the columns doc_id, text and n_chars; others may follow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from egress.llm import exact_dedup, near_dedup, packing, secret_scan, toxicity
from egress.llm.store import written


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned lexicon doesn't reject; labels of ids that aren't there, null or double do no harm."""
    lexicon = toxicity.learn(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject(docs, lexicon)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (white space aside)."""
    return exact_dedup.without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more on five-word shingles."""
    return near_dedup.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; n_chars follows the text."""
    return secret_scan.redact(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length bucket, batch and slot of each document."""
    return packing.pack(docs, "doc_id", packing.word_count("text"))


STAGES = [("toxicity", toxic), ("exact_dedup", copies), ("near_dedup", near_copies), ("secret_scan", secrets), ("packing", packed)]

#: The toxicity stage learns from labels, which SQL can't express; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
