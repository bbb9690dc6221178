"""Corpus pipeline: quality rules, near-duplicates, repeated passages, secrets, packing.

Every stage takes (spark, docs, sf_dir) and gives the documents that go on, with their columns; the last one gives the
packed pieces. ``run`` writes what a stage gives and reads it again for the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silt.llm import minhash, packing, rules, secrets, suffix
from silt.llm.common import discard, documents, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base or the learnt decision list rejects go."""
    return rules.kept_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return minhash.one_of_each(docs, "doc_id", "text")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages of about 50 words or more that repeat anywhere are cut out of the texts; n_chars follows."""
    return suffix.without_repeats(docs, "doc_id", "text", suffix.PASSAGE).withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def secret_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Values of secrets are masked, but for examples that several owners hold; n_chars follows."""
    return secrets.redact(docs, "doc_id", "text", owner="source", repo="lang").withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of what is left."""
    return packing.pack_documents(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("secret_values", secret_values),
    ("best_fit", best_fit),
]

#: Learning, signatures and byte strings are beyond SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
