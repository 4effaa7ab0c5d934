"""A training table bucketed and sorted by its row key.

Batching and packing attach a few numbers per key to the wide rows.  From a plain
table every such join moves the token arrays; over a bucketed one the wide side is
read where it lies, and only the numbers move to it.  The table is written once
and read by every epoch, batch size and packing.

Files are bucketed by Spark's own hash, one file a bucket, so the sort order
holds as well (``spark.sql.legacy.bucketedTableScan.outputOrdering``).  Bucketing is
a property of the catalog entry, not of the files: a manifest beside them
(keys, buckets, schema) lets another session enter them in its catalog again.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

ROWS_PER_BUCKET = 50_000
_MANIFEST = "_bucketing.json"


def write_bucketed(df: DataFrame, path: str, keys: str | list[str], buckets: int | None = None) -> DataFrame:
    """Write ``df`` to ``path`` bucketed and sorted by ``keys``; return the table.

    ``buckets`` defaults to one per ``ROWS_PER_BUCKET`` rows: a bucket is read by one task.
    """
    spark = df.sparkSession
    keys = [keys] if isinstance(keys, str) else list(keys)
    n = buckets or max(1, math.ceil(df.count() / ROWS_PER_BUCKET))
    name = f"bucketed_{uuid.uuid4().hex[:12]}"
    # Partitions by the same hash and number: a task writes one file, of its own bucket.
    placed = df.repartition(n, *keys).sortWithinPartitions(*keys)
    placed.write.format("parquet").mode("overwrite").option("path", path).bucketBy(n, *keys).sortBy(*keys).saveAsTable(name)
    table = spark.table(name)
    held = {"keys": keys, "buckets": n, "schema": json.loads(table.schema.json())}
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{_MANIFEST}")
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(json.dumps(held).encode()))
    finally:
        out.close()
    return table


def open_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path``, written by :func:`write_bucketed` in this or another session."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{_MANIFEST}")
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        held = json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()
    name = f"bucketed_{uuid.uuid4().hex[:12]}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromJson(held["schema"]))
    by = ", ".join(f"`{k}`" for k in held["keys"])
    where = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {held['buckets']} BUCKETS LOCATION '{where}'")
    return spark.table(name)


def buckets_by(df: DataFrame, keys: list[str]) -> int | None:
    """Number of partitions if ``df`` reads a table bucketed by exactly ``keys``, else None."""
    dealt = df._jdf.queryExecution().sparkPlan().outputPartitioning()
    if dealt.getClass().getSimpleName() != "HashPartitioning":
        return None
    parts = dealt.expressions()
    names = [parts.apply(i).toString().split("#")[0] for i in range(parts.size())]
    return dealt.numPartitions() if names == keys else None
