"""Training rows: tokenise prompts, mask labels, union splits, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogprep.functions import ids as I
from dialogprep.functions.tokens import IDS_TYPE


def encode_examples(df: DataFrame, tokenizer) -> DataFrame:
    """Add source_ids, target_ids, input_ids, labels, attention_mask.

    The source is encoded with special tokens (BOS), the target without them
    and followed by EOS unless empty.  Rows with ``copy_labels`` (TAPT) take
    their labels from the ids and have no target.
    """
    src = tokenizer.encode(F.col("source_text"), add_special=True)
    tgt = F.when(F.col("copy_labels"), F.array().cast(IDS_TYPE)).otherwise(
        I.target_ids(F.col("target_text"), tokenizer))
    out = df.withColumn("source_ids", src).withColumn("target_ids", tgt)
    out = out.withColumn("input_ids", I.concat_ids(F.col("source_ids"), F.col("target_ids")))
    out = out.withColumn(
        "labels",
        F.when(F.col("copy_labels"), I.full_labels(F.col("input_ids")))
        .otherwise(I.masked_labels(F.col("source_ids"), F.col("target_ids"))),
    )
    return out.withColumn("attention_mask", I.ones_mask(F.col("input_ids")))


def to_training_table(df: DataFrame, key: str = "example_id", extra: tuple[str, ...] = ()) -> DataFrame:
    """A4 + C13: the key and the three model columns as int64 arrays."""
    return df.select(
        key, *extra,
        I.as_long(F.col("input_ids")).alias("input_ids"),
        I.as_long(F.col("labels")).alias("labels"),
        I.as_long(F.col("attention_mask")).alias("attention_mask"),
    )


def concat_splits(train: DataFrame, dev: DataFrame, split_col: str = "split") -> DataFrame:
    """Train ++ dev as the training split; dev also stays the eval split.

    Bag union (no dedup); the result carries a ``split`` column with values
    ``train`` (train and dev rows) and ``eval`` (dev rows).
    """
    twice = F.explode(F.array(F.lit("train"), F.lit("eval")))  # one pass over dev
    return train.withColumn(split_col, F.lit("train")).unionByName(dev.withColumn(split_col, twice))


def mark_dev_rows(df: DataFrame, is_dev: Column, split_col: str = "split") -> DataFrame:
    """I1 from one table: rows where ``is_dev`` holds appear as ``train`` and as ``eval``."""
    names = F.when(is_dev, F.array(F.lit("train"), F.lit("eval"))).otherwise(F.array(F.lit("train")))
    return df.withColumn(split_col, F.explode(names))


def dataset_stats(df: DataFrame, group_cols: tuple[str, ...] = ("split",),
                  ids: str = "input_ids", limit: int = 4096) -> DataFrame:
    """rows, total tokens, longest row and rows over ``limit`` per group.

    The reference never truncates, so over-length rows are reported, not cut.
    """
    n = F.size(F.col(ids))
    return df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).cast("long").alias("n_rows"),
        F.sum(n).cast("long").alias("n_tokens"),
        F.max(n).cast("long").alias("max_tokens"),
        F.sum(F.when(n > limit, 1).otherwise(0)).cast("long").alias("n_over_limit"),
    )


def preview(df: DataFrame, tokenizer, key: str = "example_id", n: int = 1) -> DataFrame:
    """H2 + C6: the first ``n`` rows by key, decoded with specials visible.

    Labels have the ignore sentinel replaced by the pad id first, as in the
    reference's printout.  ``n`` is the feature (a preview), not a row cap.
    """
    head = df.orderBy(key).limit(n)
    return head.select(
        key,
        tokenizer.decode(F.col("input_ids"), skip_special=False).alias("input_text"),
        tokenizer.decode(I.unmask_labels(F.col("labels"), tokenizer.pad_token_id),
                         skip_special=False).alias("label_text"),
    )
