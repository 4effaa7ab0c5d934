"""Training-set build: read records -> prompts -> tokens -> labels -> table.

The reference rebuilds this in every training process; here it is one lazy
plan written once as Parquet (partitioned by split) that every consumer reads.
When the records are nested already, the plan is narrow from scan to sink;
from a flat turn table it has exactly one shuffle (the assembly).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialogprep.operators.batches import collate, pack
from dialogprep.operators.examples import concat_splits, encode_examples, to_training_table
from dialogprep.operators.prompting import build_prompts
from dialogprep.schema import PromptConfig
from dialogprep.sources.bucketed import write_bucketed
from dialogprep.sources.readers import load_examples, read_few_shot_pool


def training_rows(records: DataFrame, cfg: PromptConfig, tokenizer, pool: DataFrame | None = None) -> DataFrame:
    """Records -> prompt columns and the three model columns (plus source/target ids)."""
    return encode_examples(build_prompts(records, cfg, pool, tokenizer), tokenizer)


def build_training_set(
    spark: SparkSession,
    train_path: str,
    out_path: str,
    cfg: PromptConfig,
    tokenizer,
    dev_path: str | None = None,
    pool_path: str | None = None,
    with_train_dev: bool = False,
    fmt: str = "json",
    multi_line: bool = True,
    key: str = "example_id",
    row_token_limit: int = 4096,
    observation: Observation | None = None,
    schema: T.StructType | None = None,
    max_rejects: int = 0,
    reject_path: str | None = None,
) -> DataFrame:
    """Write ``(key, origin, split, task, task_order, input_ids, labels, attention_mask)``.

    ``origin`` is 0 for records of the training file and 1 for the dev file;
    with it keys are unique in a split even if both files number their records
    alike.  Malformed records beyond ``max_rejects`` fail the build, others go
    to ``reject_path`` (``.../train`` and ``.../dev``).

    ``split`` is ``train`` and, with a dev file, ``eval``; ``with_train_dev``
    also adds the dev rows to ``train`` (they stay the eval set too).  If an
    ``Observation`` is given it receives, from the write itself (no extra
    pass), the row count, the rows whose target was null (treated as '') and
    the rows longer than ``row_token_limit`` (kept, as the reference never
    truncates).
    """
    pool = read_few_shot_pool(spark, pool_path) if pool_path else None

    def prepared(path: str, origin: int, name: str) -> DataFrame:
        records, _ = load_examples(spark, path, fmt, multi_line, schema, key, max_rejects, reject_path and f"{reject_path}/{name}")
        return training_rows(records.withColumn("origin", F.lit(origin)), cfg, tokenizer, pool)

    train = prepared(train_path, 0, "train")
    if dev_path is None:
        table = train.withColumn("split", F.lit("train"))
    elif with_train_dev:
        table = concat_splits(train, prepared(dev_path, 1, "dev"))
    else:
        table = train.withColumn("split", F.lit("train")).unionByName(
            prepared(dev_path, 1, "dev").withColumn("split", F.lit("eval")))
    if observation is not None:
        table = table.observe(
            observation,
            F.count(F.lit(1)).alias("n_rows"),
            F.sum(F.when(F.col("output").isNull(), 1).otherwise(0)).alias("n_null_target"),
            F.sum(F.when(F.size("input_ids") > row_token_limit, 1).otherwise(0)).alias("n_over_limit"),
        )
    out = to_training_table(table, key, extra=("origin", "split", "task", "task_order"))
    out.write.mode("overwrite").partitionBy("split").parquet(out_path)
    return spark.read.parquet(out_path)


ROW_KEY = ("origin", "{key}", "task_order")  # a key is unique within its file, and with the topic task a record has two rows


def _row_key(key: str) -> list[str]:
    return [k.format(key=key) for k in ROW_KEY]


def bucket_split(table: DataFrame, path: str, split: str = "train", key: str = "example_id", buckets: int | None = None) -> DataFrame:
    """One split of a written training table, bucketed and sorted by its row key, with the rows' lengths.

    Written once; :func:`training_batches` and :func:`packed_blocks` then never move its token arrays.
    """
    rows = table.filter(F.col("split") == split).withColumn("n_tokens", F.size("input_ids"))
    return write_bucketed(rows, path, _row_key(key), buckets)


def training_batches(table: DataFrame, batch_size: int, pad_id: int, split: str = "train",
                     n_shards: int = 1, key: str = "example_id", seed: int = 42) -> DataFrame:
    """Padded batches of one split of a written training table, plain or bucketed (train: shuffled)."""
    rows = table.filter(F.col("split") == split)
    order = "shuffle" if split == "train" else "key"
    return collate(rows, batch_size, pad_id, key=_row_key(key), n_shards=n_shards, order=order, seed=seed, length=_length(table))


def packed_blocks(table: DataFrame, block_size: int, split: str = "train", group_rows: int = 1000,
                  key: str = "example_id") -> DataFrame:
    """Fixed-length blocks of one split of a written training table, plain or bucketed."""
    return pack(table.filter(F.col("split") == split), block_size, key=_row_key(key), group_rows=group_rows, length=_length(table))


def _length(table: DataFrame) -> str | None:
    return "n_tokens" if "n_tokens" in table.columns else None
