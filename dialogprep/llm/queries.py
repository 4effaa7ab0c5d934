"""Registered queries of this subpackage: thin digests of the operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogprep.llm import bpe, classifier, conversation_repair, exact_dedup, hard_negatives, license_scan, lm_score, mixing, near_dedup, quality_rules, secret_scan, topk, url_filter
from dialogprep.llm.common import table
from dialogprep.session import bound_arrow_batches

# The vocabulary files of the tokenizers package, read by the driver.
BPE_VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BPE_PATTERN = public_tokenizers.PATTERN
LM_VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")

# The url rules (host, path, verdict).
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES) + " AS rules(host, path, verdict)")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules).withColumnRenamed("id", "page_id")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", F.col("class_size").cast("long").alias("class_size"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = classifier.fit(docs, table(spark, sf_dir, "labels"))
    return classifier.classify(docs, model).withColumnRenamed("id", "doc_id")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(table(spark, sf_dir, "documents"), LM_VOCABULARY).withColumnRenamed("id", "doc_id")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_arrow_batches(spark)  # texts and ids are wide, and each task has two Python workers
    docs = table(spark, sf_dir, "documents")
    coded = bpe.decode(bpe.encode(docs, BPE_VOCABULARY, BPE_PATTERN), BPE_VOCABULARY, BPE_PATTERN)
    return coded.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(bpe.ids_text(F.col("ids")).cast("binary"), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality_rules.rate_documents(table(spark, sf_dir, "documents"))
    return rated.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        F.col("id").alias("doc_id"), n("assign"), n("access"), n("hex"),
        F.sha2(secret_scan.span_list(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secret_scan.span_list(F.col("spans")).alias("spans"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    # Anchors by id, and the shifted labels.
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0, shifted)


def damaged(rows: DataFrame) -> DataFrame:
    """What happens to a row of ``conversations``, by the remainder of its key's crc32."""
    said = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    hit = F.crc32(F.concat(said["conv_id"], F.lit(":"), said["turn"]).cast("binary")) % 20
    text = F.when(hit == 1, "").when(hit == 2, F.translate(said["text"], ".!?", "")).otherwise(said["text"])
    copies = F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(hit == 4, "user").otherwise(said["role"]).alias("role"), text.alias("text"),
                       F.explode(F.array_repeat(F.lit(0), copies)).alias("copy"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    fixed = conversation_repair.repair(damaged(rows))
    ids = rows.select("conv_id").distinct().withColumn("ck", conversation_repair.conversation_key(F.col("conv_id")))
    found = fixed.summary.join(conversation_repair.digest(fixed.lines), "ck")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return ids.join(found, "ck", "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.withColumnRenamed("id", "vec_id")


QUERIES = {f.__name__: f for f in (
    op1_url_filter, op2_mix_sources, op3_near_dedup, op4_quality_classifier, op5_exact_dedup, op6_license_scan, op7_lm_score, op8_byte_bpe,
    op9_quality_rules, op10_secret_scan, op11_hard_negatives, op12_conversation_repair, op13_top_k)}
