"""Batch collation (K1) and sequence packing (L1).

Both start from a global order of the rows (a distributed rank, see
:mod:`dialogprep.operators.ordinal`) and cut it into runs of consecutive rows:
batches of ``batch_size`` rows for collation, groups of ``group_rows`` rows for
packing (the reference packs per map batch of consecutive rows).  Every
window runs on a narrow (key, length) table and is partitioned by such a run,
so its size is bounded by a parameter, never by the data, and it never
buffers token arrays; the results are attached to the rows by key.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialogprep.operators.ordinal import (
    attach,
    by_range,
    hash_prefix_bucket,
    ordered_index,
)
from dialogprep.operators.preferences import hash_key, key_list
from dialogprep.schema import IGNORE_INDEX


def _field(name: str):
    """``x -> x[name]`` as a one-argument lambda (Spark reads a second
    parameter as the element index)."""
    return lambda x: x[name]


def shard_of(key: Column, n_shards: int) -> Column:
    """Shard id of an integer key, portable to SQL (``pmod``)."""
    return F.pmod(key, F.lit(n_shards)).cast("int")


def collate(
    df: DataFrame,
    batch_size: int,
    pad_id: int,
    key: str | list[str] = "example_id",
    n_shards: int = 1,
    ids: str = "input_ids",
    labels: str = "labels",
    mask: str = "by_pad",
    rank_col: str | None = None,
    order: str = "shuffle",
    seed: int = 42,
    length: str | None = None,
) -> DataFrame:
    """K1 (+ F3, G3): fixed-size batches with right padding to the batch max.

    Rows are taken in a seeded shuffle order (``order="shuffle"``, like the
    reference's training loader; hash-prefix buckets, no quantile pass), in
    ``key`` order (``order="key"``, the evaluation loader; ``key`` is one or
    more columns, unique together), or by an existing
    0-based ``rank_col``.  ``batch_id = rank div batch_size``; batches go
    round-robin to ``n_shards`` devices (``shard = batch_id mod n_shards``).
    ids are padded with ``pad_id``, labels with -100.  ``mask="by_pad"``
    reproduces the reference (``ids != pad``, which also hides a real EOS when
    pad equals EOS); ``mask="by_length"`` marks the original positions.

    Ranks and batch maxima are computed on (key, length) only and attached
    by key, so no window ever holds token arrays.  ``length`` names a column that
    holds the size of ``ids``, so that the narrow pass reads no arrays at all.
    Over a table bucketed by ``key`` (:mod:`dialogprep.sources.bucketed`) the
    arrays do not move.
    """
    keys = key_list(key)
    n_ids = (F.col(length) if length else F.size(ids)).alias("_n")
    if rank_col:
        narrow = df.select(*keys, rank_col, n_ids).withColumnRenamed(rank_col, "_rank")
    elif order == "shuffle":
        narrow = df.select(*keys, n_ids, hash_key(keys, seed, "shuffle").alias("_h"))
        narrow = ordered_index(narrow, ["_h", *keys], hash_prefix_bucket(F.col("_h")), rank_col="_rank")
    elif order == "key":
        narrow = ordered_index(by_range(df.select(*keys, n_ids), keys), keys, F.col("_range"), rank_col="_rank")
    else:
        raise ValueError(f"unknown order {order!r}")
    narrow = narrow.withColumn("batch_id", F.floor(F.col("_rank") / F.lit(batch_size)).cast("long"))
    narrow = narrow.withColumn("shard", F.pmod(F.col("batch_id"), F.lit(n_shards)).cast("int"))
    # Window of one batch: at most batch_size narrow rows.
    narrow = narrow.withColumn("pad_to", F.max("_n").over(Window.partitionBy("batch_id")))
    d = attach(df, narrow.select(*keys, "batch_id", "shard", "pad_to"), keys)
    n_pad = F.col("pad_to") - F.size(ids)
    d = d.withColumn("ids", F.concat(F.col(ids), F.array_repeat(F.lit(pad_id), n_pad)))
    d = d.withColumn("labels_padded",
                     F.concat(F.col(labels), F.array_repeat(F.lit(IGNORE_INDEX),
                                                            F.col("pad_to") - F.size(labels))))
    if mask == "by_pad":
        m = F.transform(F.col("ids"), lambda x: F.when(x != pad_id, 1).otherwise(0))
    elif mask == "by_length":
        m = F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), n_pad))
    else:
        raise ValueError(f"unknown mask rule {mask!r}")
    d = d.withColumn("mask", m)
    return d.drop(ids, labels).withColumnRenamed("labels_padded", "labels")


def pack(
    df: DataFrame,
    block_size: int,
    key: str | list[str] = "example_id",
    group_rows: int = 1000,
    cols: tuple[str, ...] = ("input_ids", "labels", "attention_mask"),
    length: str | None = None,
    unequal: str = "fail",
) -> DataFrame:
    """L1 (+ F4, G4): concatenate each group's arrays and cut ``block_size`` chunks.

    A group is ``group_rows`` consecutive rows in ``key`` order (one or more
    columns of any orderable type, unique together) (the reference's
    map batch).  Every column is concatenated on its own and cut at the same
    offsets, which come from the first column: its remainder past the last full
    chunk is dropped; a group with fewer than ``block_size`` tokens yields one short
    chunk; one without any yields nothing.  A column that runs out early has short
    or empty chunks, what it has beyond the first column's chunks is dropped.
    That is what ``unequal="cut"`` does, as the reference; by default a row whose
    columns differ in size fails the job, since training rows never do.

    Ranks and offsets are computed on (key, lengths) only - windows span one
    group of narrow rows - and attached by key; chunks hold at most
    ``block_size`` tokens, so the regrouping never builds an unbounded group.
    ``length`` names a column with the size that all columns have, so that the
    narrow pass reads no arrays.  Over a table bucketed by ``key`` only the
    pieces of the chunks move.
    """
    B = block_size
    keys = key_list(key)
    if unequal not in ("fail", "cut"):
        raise ValueError(f"unknown rule for unequal columns {unequal!r}")
    alike = bool(length) or unequal == "fail"
    own = {c: "_n0" if alike else f"_n{i}" for i, c in enumerate(cols)}  # a column's length
    if length:
        sizes = [F.col(length).alias("_n0")]
    elif alike:
        differ = F.raise_error(F.lit(f"columns {list(cols)} differ in length"))
        equal = functools.reduce(lambda x, y: x & y, [F.size(c) == F.size(cols[0]) for c in cols], F.lit(True))
        sizes = [F.when(equal, F.size(cols[0])).otherwise(differ).alias("_n0")]
    else:
        sizes = [F.size(c).alias(n) for c, n in own.items()]
    narrow = df.select(*keys, *sizes)
    narrow = ordered_index(by_range(narrow, keys), keys, F.col("_range"), rank_col="_rank")
    narrow = narrow.withColumn("group", F.floor(F.col("_rank") / F.lit(group_rows)).cast("long"))
    prior = Window.partitionBy("group").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(F.greatest(own[cols[0]], F.lit(0))).over(Window.partitionBy("group"))
    names = sorted(set(own.values()))
    narrow = narrow.withColumns({f"{n}s": F.coalesce(F.sum(F.greatest(n, F.lit(0))).over(prior), F.lit(0)).cast("long") for n in names} | {"_total": total.cast("long")})
    # Chunks of a group: full ones, or one short one.
    limit = F.when(F.col("_total") >= B, F.floor(F.col("_total") / B).cast("long") * B).when(F.col("_total") > 0, F.lit(B)).otherwise(F.lit(0))
    narrow = narrow.withColumn("_limit", limit.cast("long"))
    narrow = narrow.withColumns({f"{n}e": F.least(F.col(f"{n}s") + F.greatest(n, F.lit(0)), "_limit") for n in names})
    marks = [f"{n}{x}" for n in names for x in "se"]
    d = attach(df.select(*keys, *cols), narrow.select(*keys, "group", "_rank", *marks), keys)
    some = functools.reduce(lambda x, y: x | y, [F.col(f"{n}s") < F.col(f"{n}e") for n in names])
    d = d.filter(some)
    begun = [F.when(F.col(f"{n}s") < F.col(f"{n}e"), F.col(f"{n}s")) for n in names]
    ended = [F.when(F.col(f"{n}s") < F.col(f"{n}e"), F.col(f"{n}e")) for n in names]
    low, high = (F.least(*begun), F.greatest(*ended)) if len(names) > 1 else (begun[0], ended[0])
    d = d.withColumn("chunk", F.explode(F.sequence(F.floor(low / B).cast("long"), F.floor((high - 1) / B).cast("long"))))

    def piece(c: str) -> Column:
        start, end = F.col(f"{own[c]}s"), F.col(f"{own[c]}e")
        lo, hi = F.greatest(start, F.col("chunk") * B), F.least(end, (F.col("chunk") + 1) * B)
        cut = F.slice(F.col(c), (lo - start + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int"))
        return F.coalesce(cut, F.array().cast(df.schema[c].dataType)).alias(c)

    parts = d.select("group", "chunk", F.struct("_rank", *[piece(c) for c in cols]).alias("p"))
    grouped = parts.groupBy("group", "chunk").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return grouped.select(
        "group", "chunk",
        *[F.flatten(F.transform(F.col("ps"), _field(c))).alias(c) for c in cols],
    )
