"""Preference data: deterministic splits and shuffles, length filter, truncation.

The reference splits and shuffles without a seed.  Here both are keyed:
``md5(purpose || '|' || seed || '|' || key)`` orders the rows, which is reproducible, independent
of partitioning, and computes the same in DuckDB.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogprep.operators.ordinal import attach, hash_prefix_bucket, ordered_index


def hash_key(key: Column | list[str], seed: int | str, purpose: str) -> Column:
    """md5 of ``purpose|seed|key`` (``...|k1|k2...`` for several key columns) as lowercase hex.

    The purpose keeps a split and a shuffle of the same seed independent.
    """
    if isinstance(key, list):
        parts = [F.col(k).cast("string") for k in key]
        key = parts[0] if len(parts) == 1 else F.concat_ws("|", *parts)
    return F.md5(F.concat(F.lit(f"{purpose}|{seed}|"), key.cast("string")))


def key_list(key: str | list[str] | tuple[str, ...]) -> list[str]:
    """A key given as one column name or several, as a list."""
    return [key] if isinstance(key, str) else list(key)


def filter_by_length(df: DataFrame, cutoff: int = 4096, prompt: str = "prompt",
                     chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Keep pairs with ``len(prompt) + len(answer) <= cutoff`` for both answers.

    Lengths are characters (code points); array-valued columns use their size,
    as Python ``len`` would.  A native predicate, so it stays in codegen.
    """

    def n(c: str) -> Column:
        dt = df.schema[c].dataType.typeName()
        return F.size(F.col(c)) if dt == "array" else F.length(F.col(c))

    return df.filter((n(prompt) + n(chosen) <= cutoff) & (n(prompt) + n(rejected) <= cutoff))


def split_hash(df: DataFrame, key: str, test_size: float, seed: int = 42,
               split_col: str = "split") -> DataFrame:
    """H3 (one pass): test iff the first 8 hex digits of the hash < test_size * 2^32.

    Approximate test size, stable as the table grows; no shuffle at all.
    """
    threshold = format(min(int(math.floor(test_size * 2 ** 32)), 2 ** 32 - 1), "08x")
    h8 = F.substring(hash_key(F.col(key), seed, "split"), 1, 8)
    return df.withColumn(split_col, F.when(h8 < F.lit(threshold), "test").otherwise("train"))


def split_exact(df: DataFrame, key: str | list[str], test_size: float, seed: int = 42,
                split_col: str = "split", check_keys: bool = True) -> DataFrame:
    """H3 (exact): the first ``ceil(test_size * n)`` rows in (hash, key) order are test.

    The last test row is found by :func:`nth_key`, so the split itself is a
    predicate on the row: no window, no join, no shuffle of rows.  The keys are
    read two or three times while the function is called; write an expensive
    ``df`` first.  A test size >= 1 is a row count, as in the reference's
    splitter.  A null key fails the job and a repeated one the call; that check
    counts the keys' hashes, and ``check_keys=False`` leaves it out where keys are
    unique as made (positions, say).  Repeated keys then go to the same side, and
    still fail if the border falls between them.
    """
    keys = key_list(key)
    hashed = df.select(*keys, hash_key(keys, seed, "split").alias("_h"))
    if check_keys and not hashed.filter("_h IS NOT NULL").groupBy("_h").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").isEmpty():
        raise ValueError(f"repeated row key {keys}")
    border = nth_key(hashed, "_h", keys, lambda n: int(test_size) if test_size >= 1 else math.ceil(n * float(test_size)))
    null = functools.reduce(lambda x, y: x | y, [F.col(k).isNull() for k in keys])
    test = F.lit(border == "all")
    if isinstance(border, tuple):
        h = hash_key(keys, seed, "split")
        types = [df.schema[k].dataType for k in keys]
        at = F.struct(F.lit(border[0]).alias("_h"), *[F.lit(v).cast(t).alias(k) for k, v, t in zip(keys, border[1:], types, strict=True)])
        # Few rows share the border's hash, so the key is compared for these only.
        test = (h < border[0]) | ((h == border[0]) & (F.struct(h.alias("_h"), *keys) <= at))
    lost = F.raise_error(F.lit(f"null in the row key {keys}"))
    return df.withColumn(split_col, F.when(null, lost).when(test, "test").otherwise("train"))


RADIX_DIGITS = 4  # hex digits of a histogram: 65,536 counts
FEW = 10_000  # rows that are looked at one by one


def nth_key(hashed: DataFrame, hash_col: str, keys: list[str], wanted) -> tuple | str | None:
    """(hash, key...) of the row at ``wanted(number of rows)`` (from 1) in that order, by radix selection.

    A histogram of the hash's next digits, counted where the rows are and at
    most 65,536 rows in all, tells which digits the row has; rows of these digits
    are counted by the digits that follow, until few are left.  ``None`` for a
    place before the first row, ``"all"`` for the last one or beyond.
    """
    prefix, before, k = "", 0, None
    while True:
        digit = F.substring(hash_col, len(prefix) + 1, RADIX_DIGITS)
        rest = hashed.filter(F.col(hash_col).startswith(prefix)) if prefix else hashed.filter(F.col(hash_col).isNotNull())
        counts = sorted((r[0], r[1]) for r in rest.groupBy(digit.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect())
        if k is None:
            n = sum(c for _, c in counts)
            k = wanted(n)
            if k <= 0 or k >= n:
                return "all" if n and k >= n else None
        for d, c in counts:
            if before + c >= k:
                break
            before += c
        prefix += d
        if c <= FEW or len(prefix) >= 32:
            break
    rows = hashed.filter(F.col(hash_col).startswith(prefix)).select(hash_col, *keys)
    if c > FEW:  # one hash many times: only repeats of one key do that
        rows = rows.groupBy(hash_col, *keys).agg(F.count(F.lit(1)).alias("_c")).orderBy(hash_col, *keys)
        few = [(tuple(r)[:-1], r["_c"]) for r in rows.take(2)]
    else:
        few = [(tuple(r), 1) for r in rows.orderBy(hash_col, *keys).collect()]
    spread = [r for r, m in few for _ in range(min(m, k - before + 1))]
    at = k - before - 1
    if at + 1 < len(spread) and spread[at + 1] == spread[at]:
        raise ValueError(f"the split falls between rows of one key {keys}: {spread[at][1:]}")
    return spread[at]


def shuffle(df: DataFrame, key: str | list[str], seed: int = 42, rank_col: str = "shuffle_rank") -> DataFrame:
    """H1: deterministic shuffle - a global 0-based rank in (hash, key) order.

    Numbered with hash-prefix buckets: no single task sees all rows.  Use the
    rank to order, batch (``collate(..., rank_col=...)``) or sample.
    """
    keys = key_list(key)
    narrow = df.select(*keys).withColumn("_h", hash_key(keys, seed, "shuffle"))
    ranked = ordered_index(narrow, ["_h", *keys], hash_prefix_bucket(F.col("_h")), rank_col=rank_col)
    return attach(df, ranked.drop("_h"), keys)


def truncate_preferences(df: DataFrame, tokenizer, max_length: int = 4096,
                         max_prompt_length: int = 3450, keep_end: bool = True) -> DataFrame:
    """K2: token-budget truncation of (prompt, chosen, rejected).

    prompt ids start with BOS, answers end with EOS.  If prompt + longer answer
    exceeds ``max_length``, the prompt keeps its last (``keep_end``) or first
    ``max_prompt_length`` ids; if still over, each answer keeps its first
    ``max_length - max_prompt_length`` ids.
    """
    eos = F.array(F.lit(tokenizer.eos_token_id))
    d = df.withColumn("prompt_ids", tokenizer.encode(F.col("prompt"), add_special=True))
    d = d.withColumn("chosen_ids", F.concat(tokenizer.encode(F.col("chosen")), eos))
    d = d.withColumn("rejected_ids", F.concat(tokenizer.encode(F.col("rejected")), eos))
    longer = F.greatest(F.size("chosen_ids"), F.size("rejected_ids"))
    p = F.col("prompt_ids")
    over = F.size(p) + longer > max_length
    cut = (F.slice(p, F.size(p) - max_prompt_length + 1, max_prompt_length) if keep_end
           else F.slice(p, 1, max_prompt_length))
    d = d.withColumn("prompt_ids", F.when(over & (F.size(p) > max_prompt_length), cut).otherwise(p))
    d = d.withColumn("_still", F.size("prompt_ids") + longer > max_length)
    keep = max_length - max_prompt_length
    for c in ("chosen_ids", "rejected_ids"):
        d = d.withColumn(c, F.when(F.col("_still"), F.slice(F.col(c), 1, keep)).otherwise(F.col(c)))
    return d.drop("_still")


def preview_preferences(df: DataFrame, key: str | list[str], n: int = 1) -> DataFrame:
    """H2: the first ``n`` pairs of the training split by key.  ``n`` is the feature, not a row cap."""
    return df.filter(F.col("split") == "train").orderBy(*key_list(key)).limit(n)
