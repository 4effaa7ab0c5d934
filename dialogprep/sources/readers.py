"""Sources: dialogue corpora (A1), few-shot pools (A2), preference files (A3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialogprep.operators.ordinal import add_position, file_order_index, position_columns
from dialogprep.sources.json_array import CORRUPT, read_json_array
from dialogprep.sources.writers import materialize


def read_examples(spark: SparkSession, path: str, fmt: str = "json", multi_line: bool = False,
                  schema: T.StructType | None = None, id_col: str = "example_id") -> DataFrame:
    """A1: dialogue records from JSON (array document or JSON Lines) or Parquet.

    With ``schema=None`` the schema is inferred (one more pass over JSON), so
    unknown extra fields survive to the output.  Malformed JSON rows are kept
    in ``_corrupt_record`` (PERMISSIVE) - route them with
    :func:`split_corrupt`.  A file holding one JSON array yields one row per
    element (``multi_line=True``; many tasks read it, see
    :mod:`dialogprep.sources.json_array`); JSON Lines and Parquet are splittable
    as they are.

    Records without ``id_col`` are identified by their place, as in the
    reference: ``<file ordinal>-<position in file>``, zero-padded, so keys sort
    in source order whatever the splits.  They are written once under the
    checkpoint folder for that, so JSON is parsed once.
    """
    df = _read_records(spark, path, fmt, multi_line, schema)
    if id_col in df.columns:
        return df.drop("_file", "_pos")
    placed = materialize(_placed(df), "records", spark)
    return _with_position_key(placed, id_col)


def _placed(df: DataFrame) -> DataFrame:
    """Records with what tells their place; those of arrays have it already."""
    return df if "_pos" in df.columns else df.select("*", *position_columns())


def _with_position_key(placed: DataFrame, id_col: str) -> DataFrame:
    placed = placed if "_pos" in placed.columns else add_position(placed, "_file", "_pos")
    return placed.withColumn(id_col, position_key("_file", "_pos")).drop("_file", "_pos")


def _read_records(spark: SparkSession, path: str, fmt: str, multi_line: bool, schema: T.StructType | None) -> DataFrame:
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    if fmt != "json":
        raise ValueError(f"unknown format {fmt!r}")
    r = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    if schema is not None:
        if CORRUPT not in schema.fieldNames():
            schema = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
        r = r.schema(schema)
    return read_json_array(spark, path, schema) if multi_line else r.json(path)


def position_key(file_col: str, pos_col: str) -> Column:
    return F.concat(F.lpad(F.col(file_col).cast("string"), 8, "0"), F.lit("-"), F.lpad(F.col(pos_col).cast("string"), 12, "0"))


def load_examples(spark: SparkSession, path: str, fmt: str = "json", multi_line: bool = False, schema: T.StructType | None = None,
                  id_col: str = "example_id", max_rejects: int = 0, reject_path: str | None = None) -> tuple[DataFrame, bool]:
    """:func:`read_examples` for jobs: written once, rejects routed.

    Also tells whether the records brought ``id_col`` themselves.

    More than ``max_rejects`` malformed records fail the job (the reference
    stops at the first); fewer go to ``reject_path``, if given.
    """
    raw = _read_records(spark, path, fmt, multi_line, schema)
    own = id_col in raw.columns
    rows = materialize(raw.drop("_file", "_pos") if own else _placed(raw), "examples", spark)
    rows = rows if own else _with_position_key(rows, id_col)
    if CORRUPT not in rows.columns:
        return rows, own
    good, bad = split_corrupt(rows)
    n = bad.count()
    if n > max_rejects:
        raise ValueError(f"{n} malformed records in {path}, more than the {max_rejects} allowed")
    if reject_path:
        bad.select(id_col, CORRUPT).write.mode("overwrite").json(reject_path)
    return good, own


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows) of a PERMISSIVE JSON read."""
    if CORRUPT not in df.columns:
        return df, df.limit(0)
    good = df.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    bad = df.filter(F.col(CORRUPT).isNotNull())
    return good, bad


def read_few_shot_pool(spark: SparkSession, path: str, text_col: str = "text") -> DataFrame:
    """A2: a CSV pool with a header row -> (pos, text), ``pos`` = 0-based file order.

    Quoted cells may contain newlines and doubled quotes.  A folder of part
    files is read in (file name, position in file) order.
    """
    raw = (spark.read.option("header", True).option("multiLine", True)
           .option("escape", '"').option("quote", '"').csv(path))
    ranked = file_order_index(raw.select(F.col(text_col).alias("text")), rank_col="pos")
    return ranked.select(F.col("pos").cast("int").alias("pos"), "text")


PREFERENCE_FILE_SCHEMA = T.StructType(
    [
        T.StructField("prompt", T.ArrayType(T.StringType())),
        T.StructField("chosen", T.ArrayType(T.StringType())),
        T.StructField("rejected", T.ArrayType(T.StringType())),
        T.StructField(CORRUPT, T.StringType()),
    ]
)


def _preference_objects(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """Objects in source order, ``why`` null for good ones."""
    r = spark.read.schema(PREFERENCE_FILE_SCHEMA).option("multiLine", multi_line).option("mode", "PERMISSIVE")
    raw = file_order_index(r.option("columnNameOfCorruptRecord", CORRUPT).json(path), "obj")
    missing = F.col("prompt").isNull() | F.col("chosen").isNull() | F.col("rejected").isNull()
    n = F.size("prompt")
    why = (F.when(F.col(CORRUPT).isNotNull(), "malformed object").when(missing, "missing array")
           .when((n != F.size("chosen")) | (n != F.size("rejected")), "arrays differ in length"))
    return raw.withColumn("why", why)


def read_preferences(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A3: column-oriented preference objects -> rows (obj, pos, prompt, chosen, rejected).

    Each JSON object holds three equally long arrays; a folder may hold many
    such objects (one per line with ``multi_line=False``), so large sets stay
    split across files.  A malformed object, a missing array or unequal arrays
    fail the job, as in the reference; :func:`read_preference_rejects` lists
    them.  ``obj`` is the object's ordinal in (file name, position) order and
    ``pos`` the index in it: neither depends on splits or on where the files lie.
    """
    objects = _preference_objects(spark, path, multi_line)
    fail = F.raise_error(F.concat(F.lit("preference object "), F.col("obj").cast("string"), F.lit(": "), F.col("why")))
    # The check is part of what is exploded, so no filter can run before it.
    pairs = F.when(F.col("why").isNotNull(), fail).otherwise(F.arrays_zip("prompt", "chosen", "rejected"))
    rows = objects.select("obj", F.posexplode(pairs).alias("pos", "r"))
    return rows.select("obj", F.col("pos").cast("int").alias("pos"), F.col("r.prompt").alias("prompt"),
                       F.col("r.chosen").alias("chosen"), F.col("r.rejected").alias("rejected"))


def read_preference_rejects(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """The objects that :func:`read_preferences` would fail on: (obj, why, record)."""
    return _preference_objects(spark, path, multi_line).filter(F.col("why").isNotNull()).select("obj", "why", F.col(CORRUPT).alias("record"))
