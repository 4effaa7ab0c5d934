"""Preference-set build: read -> split -> length filter -> truncate -> shuffle -> write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogprep.operators.preferences import filter_by_length, shuffle, split_exact, truncate_preferences
from dialogprep.sources.readers import position_key, read_preferences
from dialogprep.sources.writers import materialize


def preference_rows(prefs: DataFrame, tokenizer, key: str = "pair_id", cutoff: int = 4096,
                    test_size: float = 0.01, seed: int = 42, max_length: int = 4096,
                    max_prompt_length: int = 3450, check_keys: bool = True) -> DataFrame:
    """Split (exact, keyed), filter by characters, truncate by tokens, shuffle the training split.

    The filter runs after the split, on both splits, as in the reference;
    ``shuffle_rank`` is null on the test split, which is not shuffled.
    """
    s = split_exact(prefs, key, test_size, seed, check_keys=check_keys)
    f = filter_by_length(s, cutoff)
    t = truncate_preferences(f, tokenizer, max_length, max_prompt_length)
    train = shuffle(t.filter(F.col("split") == "train"), key, seed)
    return train.unionByName(t.filter(F.col("split") != "train"), allowMissingColumns=True)


def build_preference_set(spark: SparkSession, path: str, out_path: str, tokenizer,
                         multi_line: bool = True, **kw) -> DataFrame:
    """Read column-oriented preference files and write the prepared pairs by split.

    The parsed rows are written once under the checkpoint folder: the exact
    split reads its input twice (numbering and bucket totals), and a JSON
    document should be parsed only once.
    """
    raw = read_preferences(spark, path, multi_line=multi_line)
    rows = materialize(raw.withColumn("pair_id", position_key("obj", "pos")), "preference_rows", spark)
    out = preference_rows(rows, tokenizer, key="pair_id", **{"check_keys": False} | kw)  # positions are unique
    out.write.mode("overwrite").partitionBy("split").parquet(out_path)
    return spark.read.parquet(out_path)
