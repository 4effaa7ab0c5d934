"""Exact dedup: skew-safe combining of equal texts.

Three levels, each grouping by the digest *and* the full normalised text, so
equal digests of different texts never merge:

1. map side: Spark's partial aggregation folds the copies that a task sees;
2. salted groups ``(digest, text, salt)``: the salt is a hash of the id, with
   sqrt(rows) salts, so a group with any share of all rows is spread and the
   id list of one salted group stays near sqrt(rows);
3. the salted groups' winners are combined per ``(digest, text)``; the list
   there has one entry per salt.

The verdict returns to the documents through the salted groups (one row each),
never through a join on the hot digest.

Defined results: null text is the empty text; texts differ only if they differ
after lower-casing A-Z; a null id is smaller than any other; of repeated rows
with the same id and text exactly one is kept; an empty table gives no rows;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogprep.llm.common import ascii_lower, rows_of, salt, salt_count, text_of


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None) -> DataFrame:
    """One row per document: ``id, keep_id, group_size, kept, digest, h``
    (``digest``: SHA-256 of the normalised text, ``h``: its 64-bit hash).

    The groups' digest is the short hash: their key holds the full text anyway.
    """
    n_salts = salts or salt_count(docs.count())
    rows = docs.select(docs[id_col].alias("id"), ascii_lower(text_of(docs[text_col])).alias("norm"))
    rows = rows.select("id", "norm", F.xxhash64("norm").alias("h"), salt(F.col("id"), n_salts).alias("salt"))
    salted = rows.groupBy("h", "norm", "salt").agg(F.collect_list(F.struct("id")).alias("ids"))
    salted = salted.select("h", "norm", "salt", "ids", F.array_max("ids")["id"].alias("rep"))
    winners = salted.select("h", "norm", F.struct(F.col("rep").alias("rep"), F.col("salt").alias("salt"), F.size("ids").cast("long").alias("n")).alias("w"))
    combined = winners.groupBy("h", "norm").agg(F.collect_list("w").alias("ws"))
    combined = combined.select(
        F.col("h").alias("d"), F.array_max("ws")["rep"].alias("keep_id"),
        F.aggregate("ws", F.lit(0).cast("long"), lambda a, w: a + w["n"]).alias("group_size"), F.explode("ws").alias("w"),
    ).select("d", "keep_id", "group_size", F.col("w.rep").alias("r"), F.col("w.salt").alias("s"))
    left = salted.select("h", "salt", "rep", "ids", F.sha2(F.col("norm").cast("binary"), 256).alias("digest"))
    # Null-safe on all keys: a plain equality would add not-null filters to one
    # branch, and the two branches would no longer share one exchange.
    same = [left[a].eqNullSafe(combined[b]) for a, b in (("h", "d"), ("salt", "s"), ("rep", "r"))]
    both = left.join(combined, same[0] & same[1] & same[2])
    each = both.select("h", "digest", "keep_id", "group_size", F.posexplode(F.sort_array("ids", asc=False)).alias("i", "e"))
    return each.select(
        F.col("e.id").alias("id"), "keep_id", "group_size",
        (F.col("e.id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 0)).alias("kept"), "digest", "h",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all its columns."""
    kept = exact_groups(docs, id_col, text_col).filter("kept").select("id", "h")
    return rows_of(docs, kept, id_col, F.xxhash64(ascii_lower(text_of(docs[text_col]))))
