"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialogprep.session import ensure_checkpoint_dir

# ASCII letters, and the white space that separates words.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE_CLASS}]+"


def text_of(col: Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(col.cast("string"), F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; texts of ASCII alone take the built-in byte path."""
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def words(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(WORD), F.lit(0))


def id_crc(col: Column) -> Column:
    """crc32 of the id written as text (null as empty text)."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def keep_and_release(df: DataFrame) -> DataFrame:
    """:func:`keep`, and Spark removes the shuffle files as soon as ``df`` is written.

    Nothing reads them again.  Else they stay on the executors' disks until the
    driver happens to collect its garbage: many rounds' files at once.
    """
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        return keep(df.select("*"))  # the setting is read as a query is made
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def salt(col: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(n)).cast("int")


def salt_count(n_rows: int) -> int:
    """Salts for groups that may hold any share of ``n_rows``: with sqrt(n)
    salts, a salted group and the list of a group's salts both stay near
    sqrt(n) entries."""
    return max(1, math.isqrt(max(n_rows, 0)))


def join_small(left: DataFrame, small: DataFrame, key: str, spread_by: Column, salts: int = 16, left_key: str | None = None) -> DataFrame:
    """Left join with a table of one row per ``key`` (null is a key of its own; ``left_key`` if its name differs).

    Spark broadcasts ``small`` when its size, as measured, is under
    ``spark.sql.autoBroadcastJoinThreshold``.  Beyond it, the salted key keeps
    a hot ``key`` from meeting in one task: ``small`` is repeated ``salts``
    times, the large side is not.
    """
    right = small.withColumnRenamed(key, "_jk").withColumn("_js", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = left.withColumn("_ls", salt(spread_by, salts))
    cond = left[left_key or key].eqNullSafe(right["_jk"]) & (left["_ls"] == right["_js"])
    return left.join(right, cond, "left").drop("_jk", "_js", "_ls")


def running(df: DataFrame, order: list[Column], sums: dict[str, str], per_part: int = 100_000) -> DataFrame:
    """Global position and running sums without a single-task window.

    Rows are range-partitioned by ``order`` (which must be unique) and written;
    inside a range a window numbers and sums them, and the totals of the
    ranges, one row each, give the offsets.  Adds ``_pos`` (from 1) and, for
    each ``out: in`` of ``sums``, the sum of ``in`` over all rows before.
    """
    n = max(1, math.ceil(df.count() / per_part))
    parts = keep(df.repartitionByRange(n, *order).withColumn("_rp", F.spark_partition_id()))
    totals = parts.groupBy("_rp").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    before = Window.orderBy("_rp").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_rp", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
                            *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_o_{o}") for o in sums])
    within = Window.partitionBy("_rp").orderBy(*order)
    prior = within.rowsBetween(Window.unboundedPreceding, -1)
    out = parts.withColumn("_pos", F.row_number().over(within))
    for o, c in sums.items():
        out = out.withColumn(o, F.coalesce(F.sum(c).over(prior), F.lit(0)))
    out = out.join(offsets, "_rp").withColumn("_pos", F.col("_pos") + F.col("_n0"))
    for o in sums:
        out = out.withColumn(o, F.col(o) + F.col(f"_o_{o}"))
    return out.drop("_rp", "_n0", *[f"_o_{o}" for o in sums])


def rows_of(docs: DataFrame, kept: DataFrame, id_col: str, text_hash: Column) -> DataFrame:
    """Rows of ``docs`` whose (id, hash of the text) is in ``kept`` (``id, h``, unique).

    Of rows that repeat both, the least by all values stays.  Join and window
    use the same three columns, none of them nullable, so the texts move once.
    """
    def pair(i: Column, h: Column) -> list[Column]:
        return [F.coalesce(i.cast("string"), F.lit("")).alias("k0"), i.isNull().alias("k1"), h.alias("k2")]

    k = kept.select(*pair(kept["id"], kept["h"]))
    d = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *pair(docs[id_col], text_hash))
    d = d.join(k, ["k0", "k1", "k2"], "left_semi")
    same = Window.partitionBy("k0", "k1", "k2").orderBy("row")
    return d.withColumn("nth", F.row_number().over(same)).filter("nth = 1").select("row.*")
