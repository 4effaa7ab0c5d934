"""Global row numbers and running totals without a single-partition window.

Spark's ``row_number().over(Window.orderBy(k))`` moves every row into one
task.  Here the order key is first mapped to a *bucket* that is monotone in the
key; rows are numbered (and summed) inside their bucket with a window
partitioned by the bucket, and the per-bucket totals - one row per bucket, so
bounded by the bucket count - are turned into offsets and joined back.
Cost: one shuffle of the data plus a key-only aggregate.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialogprep.session import ensure_checkpoint_dir

# Hash-prefix buckets use 4 hex digits: 65,536 buckets, so the offset table
# stays near 1.5 MB while a bucket holds ~1/65,536 of the rows.
HASH_BUCKET_DIGITS = 4


def hash_prefix_bucket(hex_col: Column, digits: int = HASH_BUCKET_DIGITS) -> Column:
    """Bucket of a lowercase hex digest: its first ``digits`` hex digits as int.

    Monotone in the digest's string order; uniform because the digest is a hash.
    """
    return F.coalesce(F.conv(F.substring(hex_col, 1, digits), 16, 10).cast("int"), F.lit(-1))


# Rows of one range of :func:`by_range`: a window holds about this many narrow rows.
ROWS_PER_RANGE = 200_000


def by_range(df: DataFrame, order_cols: list[str], rows_per_range: int = ROWS_PER_RANGE, col: str = "_range") -> DataFrame:
    """``df`` (a narrow projection) with an ordinal of its range in ``order_cols`` order.

    Works for any orderable type.  Ranges come from Spark's range partitioning
    and their number from the row count, so a range does not grow with the
    table.  The rows are written first (they are counted and sampled), and the
    ranges too, because a second evaluation could draw other bounds.
    """
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.checkpoint()
    n = max(1, math.ceil(rows.count() / rows_per_range))
    return rows.repartitionByRange(n, *order_cols).withColumn(col, F.spark_partition_id()).checkpoint()


def ordered_index(
    df: DataFrame,
    order_cols: list[str],
    bucket: Column,
    rank_col: str | None = "rank",
    value: Column | None = None,
    running_col: str | None = None,
    partition_cols: tuple[str, ...] = (),
    total_col: str | None = None,
) -> DataFrame:
    """Add a 0-based dense rank and/or an inclusive running total.

    Works in place on ``df``: pass a narrow projection (keys and values) and
    :func:`attach` the result to wide rows.  ``total_col`` also adds the row count of the (partition of the) table,
    taken from the same per-bucket totals - no extra pass.

    ``bucket`` must be non-decreasing in ``order_cols`` (within
    ``partition_cols``); ``order_cols`` must be unique within a partition.

    Plan: one hash exchange on the bucket feeds the numbering window; the
    per-bucket totals are aggregated from the same numbered rows (so the
    exchange is reused) and joined back on the bucket.  The numbered side is
    already partitioned and sorted by the bucket, so that join shuffles only
    the small totals side; AQE turns it into a broadcast when the measured
    totals are small.
    """
    pcols = list(partition_cols)
    b = df.withColumn("_bkt", bucket)
    if value is not None:
        b = b.withColumn("_val", value)
    w = Window.partitionBy(*pcols, "_bkt").orderBy(*order_cols)
    local = [(F.row_number().over(w) - 1).alias("_rank_local")]
    if value is not None:
        local.append(F.sum("_val").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_run_local"))
    numbered = b.select("*", *local)

    sizes_aggs = [F.count(F.lit(1)).alias("_n")]
    if value is not None:
        sizes_aggs.append(F.sum("_val").alias("_v"))
    sizes = numbered.groupBy(*pcols, "_bkt").agg(*sizes_aggs)
    # One row per (partition, bucket): the window below is bounded by the
    # bucket count, which the caller fixes.
    prev = Window.partitionBy(*pcols).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    off_cols = [F.coalesce(F.sum("_n").over(prev), F.lit(0)).alias("_n_off")]
    if value is not None:
        off_cols.append(F.coalesce(F.sum("_v").over(prev), F.lit(0)).alias("_v_off"))
    if total_col is not None:
        off_cols.append(F.sum("_n").over(Window.partitionBy(*pcols)).alias("_n_total"))
    offsets = sizes.select(*pcols, "_bkt", *off_cols)

    out = numbered.join(offsets, on=[*pcols, "_bkt"], how="inner")
    adds = []
    if rank_col is not None:
        adds.append((F.col("_n_off") + F.col("_rank_local")).cast("long").alias(rank_col))
    if value is not None:
        adds.append((F.col("_v_off") + F.col("_run_local")).alias(running_col or "running"))
    if total_col is not None:
        adds.append(F.col("_n_total").cast("long").alias(total_col))
    return out.select(*df.columns, *adds)


def attach(df: DataFrame, per_key: DataFrame, keys: list[str]) -> DataFrame:
    """Join results computed on a narrow per-key projection back to the full rows.

    Windows then never buffer wide rows (a window holds a whole partition
    group in memory before it spills, counted in rows, not bytes).  When ``df``
    is already partitioned by the key - as assembled records are - the wide
    side of this join does not move; a table read from files moves once.
    So does nothing of a table bucketed by the keys (:mod:`dialogprep.sources.bucketed`):
    the narrow side goes to its buckets.  A null or repeated key fails the job.
    """
    from dialogprep.sources.bucketed import buckets_by

    n = buckets_by(df, keys)
    if n:
        per_key = per_key.repartition(n, *keys)
    # A null key would vanish in the join and a repeated one would multiply its
    # rows, so both fail the job.  The left join keeps the wide side's
    # partitioning; the check rides on the attached columns.
    adds = [c for c in per_key.columns if c not in keys]
    per = per_key.withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    is_null = functools.reduce(lambda x, y: x | y, [F.col(k).isNull() for k in keys])
    per = per.withColumn("_ok", F.when(F.col("_same") > 1, F.raise_error(F.lit(f"repeated row key {keys}"))).otherwise(~is_null))
    if set(df.columns) <= set(per_key.columns):
        joined, adds = per, [c for c in adds if c not in df.columns]
    else:
        joined = df.join(per.select(*keys, "_ok", *adds), on=keys, how="left")
    lost = F.raise_error(F.lit(f"null in the row key {keys}"))
    return joined.select(*df.columns, *[F.when(F.coalesce("_ok", F.lit(False)), F.col(c)).otherwise(lost).alias(c) for c in adds])


def order_rank(df: DataFrame, key: str, rank_col: str = "rank", total_col: str | None = None) -> DataFrame:
    """0-based rank of a unique ``key`` of any orderable type, without a single-task window.

    Computed on the key column alone and attached to the rows by key.
    """
    ranked = ordered_index(by_range(df.select(key), [key]), [key], F.col("_range"), rank_col=rank_col, total_col=total_col)
    return attach(df, ranked.drop("_range"), [key])


def position_columns() -> list[Column]:
    """What tells a record's place in its source: file, begin of the split, row in the task."""
    return [F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m")]


def add_position(placed: DataFrame, file_col: str | None = None, pos_col: str | None = None, rank_col: str | None = None) -> DataFrame:
    """Ordinal of the file (by name), 0-based position in it, 0-based rank over all files.

    ``placed`` carries :func:`position_columns` of its scan.  A task reads a
    split's records one after the other, so a record's position is its row
    number in the split plus the counts of the splits before: one row per
    split, and no window over records at all.
    """
    splits = placed.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_m0"))
    prior = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    in_file = Window.partitionBy("_f").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(
        F.col("_f").alias("_sf"), F.col("_b").alias("_sb"), "_m0", (F.dense_rank().over(Window.orderBy("_f")) - 1).alias("_sfile"),
        F.coalesce(F.sum("_n").over(in_file), F.lit(0)).alias("_p0"), F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias("_r0"))
    d = placed.join(splits, (placed["_f"] == splits["_sf"]) & (placed["_b"] == splits["_sb"]))
    row = F.col("_m") - F.col("_m0")
    out = [c for c in ((file_col, F.col("_sfile").cast("int")), (pos_col, (F.col("_p0") + row).cast("long")), (rank_col, (F.col("_r0") + row).cast("long"))) if c[0]]
    return d.withColumns(dict(out)).drop("_f", "_b", "_m", "_sf", "_sb", "_m0", "_sfile", "_p0", "_r0")


def file_order_index(df: DataFrame, rank_col: str = "rank") -> DataFrame:
    """0-based rank of a scan's rows in (file name, position in file) order."""
    return add_position(df.select("*", *position_columns()), rank_col=rank_col)


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Round-robin repartition of a source scan, if the caller asks for it.

    For inputs stored in fewer splits than the cluster has cores (one row group
    per file, say): ``partitions``, or the session's
    ``spark.dialogprep.spreadPartitions``.  Without either the scan stays as it
    is, whatever its size; large inputs are better written in smaller row groups.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.dialogprep.spreadPartitions", "0"))
    return df.repartition(n) if n > 0 else df
