"""Corpus pipeline: quality, exact dedup, near-dedup, mixing, encoding.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor
kept; its result is written as Parquet and read again as the next stage's docs.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogprep.llm import bpe, classifier, exact_dedup, mixing, near_dedup
from dialogprep.llm.common import table
from dialogprep.session import ARROW_BYTES, bound_arrow_batches, drop_path, restore_arrow_batches, scratch_path

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fit on the labelled ones, accepts."""
    model = classifier.fit(docs, table(spark, sf_dir, "labels"))
    return classifier.accept(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one of largest doc_id."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one of least doc_id."""
    return near_dedup.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out, so that sources meet their targets."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether decoding them gives the text back."""
    bound_arrow_batches(spark)  # texts and ids are wide, and each task has two Python workers
    coded = bpe.decode(bpe.encode(docs, VOCABULARY, PATTERN), VOCABULARY, PATTERN)
    return coded.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("bytes", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mix", mix), ("encode", encode)]

# The classifier and the near-dedup are beyond SQL; tests hold the stages
# against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again."""
    docs, before, arrow = table(spark, sf_dir, "documents"), None, spark.conf.get(ARROW_BYTES, None)
    try:
        for name, stage in STAGES:
            path = scratch_path(spark, f"pipeline-{name}")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                drop_path(spark, before)  # read to the end by the stage just written
            before = path
    finally:
        restore_arrow_batches(spark, arrow)
    return docs
