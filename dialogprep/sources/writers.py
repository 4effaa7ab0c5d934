"""Sinks: prediction lines (A5), submissions as ordered parts or one document (A6), materialised tables."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogprep.session import drop_path, ensure_checkpoint_dir


def record_json(df: DataFrame) -> Column:
    """The whole row as one JSON string; non-ASCII kept, nulls written."""
    return F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"})


def write_predictions(df: DataFrame, path: str, fmt: str = "jsonl", mode: str = "overwrite") -> None:
    """A5: one JSON record per example (UTF-8, unescaped, nulls kept), or Parquet."""
    if fmt == "jsonl":
        df.write.mode(mode).option("ignoreNullFields", False).json(path)
    elif fmt == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def write_submission(df: DataFrame, path: str, order_col: str = "pos", mode: str = "overwrite",
                     as_json_array: bool = False, materialized: bool = False,
                     drop: tuple[str, ...] = ()) -> None:
    """Records in original order, written by many tasks.

    The input is first written once under the checkpoint folder (unless
    ``materialized``): ordering samples its input and the array form reads
    its key range, and neither should re-run an expensive upstream such as a
    generator.  ``orderBy`` range-partitions, so the part files in name order
    hold the records in ``order_col`` order (a unique key).  By default they
    are JSON Lines.  With ``as_json_array`` each line is one array element (the
    first opens the array, the last closes it), so the parts concatenated in
    name order are one JSON array document, as the reference writes - without
    funnelling the records through a single writer.  An empty input writes
    ``[]``.  ``drop`` names helper columns that order but are not written.
    """
    src = df if materialized else materialize(df, "submission_input")
    written = src.columns if not drop else [c for c in src.columns if c not in drop]
    if not as_json_array:
        src.orderBy(order_col).select(*written).write.mode(mode).option("ignoreNullFields", False).json(path)
        _drop(src, materialized)
        return
    if src.isEmpty():
        src.sparkSession.range(1).select(F.lit("[]").alias("value")).write.mode(mode).text(path)
        _drop(src, materialized)
        return
    key = F.col(order_col)
    lo = src.agg(F.min(order_col)).scalar()
    hi = src.agg(F.max(order_col)).scalar()
    line = F.concat(
        F.when(key == lo, F.lit("[\n")).otherwise(F.lit("")),
        F.lit("  "), record_json(src.select(*written)),
        F.when(key == hi, F.lit("\n]")).otherwise(F.lit(",")),
    )
    src.orderBy(order_col).select(line.alias("value")).write.mode(mode).text(path)
    _drop(src, materialized)


def _drop(src: DataFrame, materialized: bool) -> None:
    """Delete the written copy of a finished sink."""
    if not materialized and src.inputFiles():
        drop_path(src.sparkSession, src.inputFiles()[0].rsplit("/", 1)[0])


def write_document(df: DataFrame, path: str, order_col: str = "pos", indent: int = 2, drop: tuple[str, ...] = (),
                   materialized: bool = False) -> None:
    """The records in ``order_col`` order as one JSON array in one file at ``path``, indented like ``json.dump``.

    Records become indented text in parallel; one task then writes the sorted
    texts, streaming, since a file has one writer.  Two phases: that task writes
    to a folder beside ``path`` under Spark's commit protocol, and the finished
    file is moved to ``path`` in one step, over an earlier one.  Until then, and after
    any failure, ``path`` is as it was.  Very large results are better left as
    the ordered parts of :func:`write_submission`.
    """
    spark = df.sparkSession
    src = df if materialized else materialize(df, "document_input")
    written = [c for c in src.columns if c not in drop]
    stage = f"{path.rstrip('/')}.stage-{uuid.uuid4().hex[:12]}"
    try:
        last = src.agg(F.max(order_col)).scalar()  # a plan that fails is not begun
        texts = src.select(F.col(order_col).alias("_o"), (F.col(order_col) == last).alias("_last"), record_json(src.select(*written)).alias("_t"))
        lines = _indented(texts, indent).repartition(1).sortWithinPartitions("_o")
        if src.isEmpty():
            lines = spark.range(1).select(F.lit("[]").alias("_t"))
        lines.select("_t").coalesce(1).write.option("compression", "none").text(stage)
        _publish_only_part(spark, stage, path)
    finally:
        drop_path(spark, stage)
        _drop(src, materialized)


def _indented(texts: DataFrame, indent: int) -> DataFrame:
    """``_t`` as an element of an indented array; brackets go with the first and the last one."""
    first = texts.agg(F.min("_o")).scalar()
    pad = " " * indent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [json.dumps(json.loads(t), indent=indent, ensure_ascii=False).replace("\n", "\n" + pad) for t in b.column("_t").to_pylist()]
            yield pa.record_batch([b.column("_o"), b.column("_last"), pa.array([pad + t for t in out], pa.string())], names=["_o", "_last", "_t"])

    d = texts.mapInArrow(run, texts.schema)
    text = F.concat(F.when(F.col("_o") == first, "[\n").otherwise(""), F.col("_t"), F.when(F.col("_last"), "\n]").otherwise(","))
    return d.select("_o", text.alias("_t"))


def _publish_only_part(spark: SparkSession, stage: str, path: str) -> None:
    """Move the one part file of ``stage`` to ``path``, replacing what is there."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(stage)
    parts = [s.getPath() for s in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder) if s.getPath().getName().startswith("part-")]
    if len(parts) != 1:
        raise RuntimeError(f"{len(parts)} parts in {stage}, expected one")
    _rename(spark, parts[0].toString(), path, overwrite=True)


def _rename(spark: SparkSession, source: str, target: str, overwrite: bool) -> None:
    """Rename in one step; without ``overwrite`` it fails if the target is there."""
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    options[0] = fs.Options.Rename.OVERWRITE if overwrite else fs.Options.Rename.NONE
    at = fs.Path(target)
    fs.FileContext.getFileContext(at.getFileSystem(spark._jsc.hadoopConfiguration()).getUri(), spark._jsc.hadoopConfiguration()).rename(fs.Path(source), at, options)


def materialize(df: DataFrame, name: str, spark: SparkSession | None = None,
                config: object = None, reuse: bool = False) -> DataFrame:
    """Write to Parquet under the shared checkpoint folder and read back.

    Reading back cuts the lineage, so a lost executor never recomputes the
    upstream plan, and later jobs read only the columns they need.  Every call
    writes a folder of its own.

    With ``reuse=True`` a complete earlier result of the same computation is
    reused (the reference's cache-file behaviour).  The key is ``name``, ``config``,
    and the computation: the normalised logical plan with all its fields, and
    for each of its leaves, in order, the input files (path, size, time) or local
    rows.  A finished folder is published by moving a manifest of its files into
    place, in one step and only if there is none: readers see a whole table or
    none, and of concurrent writers the first one's is used by all.  A manifest
    whose files are gone or changed is replaced.  Plans whose leaves have no
    identity (cached or checkpointed tables, RDDs) cannot be reused; plans with
    Python functions only with a ``config`` that names their version.
    """
    spark = spark or df.sparkSession
    root = ensure_checkpoint_dir(spark)
    folder = f"{root}/dialogprep-cache/{name}-{uuid.uuid4().hex[:12]}"
    if not reuse:
        df.write.mode("overwrite").parquet(folder)
        return spark.read.parquet(folder)
    key = hashlib.sha256(json.dumps([name, repr(config), computation(df, config is not None)]).encode()).hexdigest()[:32]
    manifest = f"{root}/dialogprep-cache/{name}-{key}.manifest"
    found = _valid_manifest(spark, manifest)
    if found:
        return spark.read.schema(df.schema).parquet(found)
    df.write.parquet(folder)
    try:
        _write_manifest(spark, manifest, folder)
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in str(e.java_exception):
            raise
        found = _valid_manifest(spark, manifest)
        if found:  # another writer was first
            drop_path(spark, folder)
            return spark.read.schema(df.schema).parquet(found)
        drop_path(spark, manifest)
        _write_manifest(spark, manifest, folder)
    return spark.read.schema(df.schema).parquet(folder)


# Settings that change what a plan computes.
_MEANING = ("spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.caseSensitive")


def computation(df: DataFrame, versioned: bool = False) -> list:
    """What ``df`` computes, as values that are equal for equal computations over unchanged inputs."""
    spark = df.sparkSession
    top = df._jdf.queryExecution().analyzed()
    inner = top.subqueriesAll()
    plans = [top, *(inner.apply(i) for i in range(inner.size()))]
    patterns = spark._jvm.org.apache.spark.sql.catalyst.trees.TreePattern
    texts, leaves = [], []
    for plan in plans:
        text = plan.canonicalized().treeString(True, False, 2 ** 31 - 1, False, False)
        functions = any(plan.containsPattern(getattr(patterns, p)()) for p in ("PYTHON_UDF", "SCALA_UDF")) or re.search(r"MapIn|InPandas|InArrow|MapPartitions|MapElements", text)
        if functions and not versioned:
            raise ValueError("a plan with functions of the user can be reused only with a config that names their version")
        texts.append(text)
        found = plan.collectLeaves()
        leaves += [_leaf(spark, found.apply(i)) for i in range(found.size())]
    # The normalised plan has no column names.
    return [df.schema.json(), texts, leaves, [spark.conf.get(k) for k in _MEANING]]


def _leaf(spark: SparkSession, leaf) -> list:
    """Identity of a plan's leaf: the state of its files, or its rows."""
    kind = leaf.getClass().getSimpleName()
    if kind == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
        return [kind, _file_states(spark, leaf.relation().location().inputFiles())]
    if kind == "LocalRelation":
        return [kind, hashlib.sha256(leaf.data().mkString("|").encode()).hexdigest()]
    if kind in ("Range", "OneRowRelation"):
        return [kind, leaf.toString()]
    raise ValueError(f"a result over {kind} cannot be reused: it has no identity; write it to files first")


def _file_states(spark: SparkSession, uris) -> list[tuple[str, int, int]]:
    """(path, bytes, modification time) of files, sorted."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = []
    for f in sorted(uris):
        p = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f))
        s = p.getFileSystem(conf).getFileStatus(p)
        out.append((f, s.getLen(), s.getModificationTime()))
    return out


def _write_manifest(spark: SparkSession, manifest: str, folder: str) -> None:
    """Publish ``folder``: its files' sizes, written aside and moved into place if there is no manifest yet."""
    fs, status = _listing(spark, folder)
    text = json.dumps({"folder": folder, "files": status})
    aside = f"{folder}.manifest"
    out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(aside), False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    try:
        _rename(spark, aside, manifest, overwrite=False)
    finally:
        drop_path(spark, aside)


def _listing(spark: SparkSession, folder: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, sorted([s.getPath().getName(), s.getLen()] for s in fs.listStatus(p))


def _valid_manifest(spark: SparkSession, manifest: str) -> str | None:
    """The folder a manifest names, if its files are all there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(manifest)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        held = json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()
    try:
        return held["folder"] if _listing(spark, held["folder"])[1] == sorted(held["files"]) else None
    except Py4JJavaError:  # the folder is gone
        return None


def write_preferences(df: DataFrame, path: str, key: str = "example_id", rows_per_object: int = 10000,
                      mode: str = "overwrite") -> None:
    """The reference's column-oriented preference format, written in pieces.

    Rows are taken in ``key`` order and cut into objects of at most
    ``rows_per_object`` rows; each object ``{prompt: [...], chosen: [...],
    rejected: [...]}`` is one JSON line, so no object (and no task) grows with
    the table.  :func:`~dialogprep.sources.readers.read_preferences` with
    ``multi_line=False`` reads the folder back.
    """
    from dialogprep.operators.ordinal import order_rank

    ranked = order_rank(df.select(key, "prompt", "chosen", "rejected"), key, "_rank")
    objs = ranked.groupBy(F.floor(F.col("_rank") / rows_per_object).alias("_obj")).agg(
        F.array_sort(F.collect_list(F.struct("_rank", "prompt", "chosen", "rejected"))).alias("_r"))
    objs.select(
        F.transform("_r", lambda x: x["prompt"]).alias("prompt"),
        F.transform("_r", lambda x: x["chosen"]).alias("chosen"),
        F.transform("_r", lambda x: x["rejected"]).alias("rejected"),
    ).write.mode(mode).json(path)
