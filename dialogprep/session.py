"""Session settings and the shared scratch folder.

Scratch output (materialised tables, written-and-reread checks) goes under the
folder the cluster names in ``spark.checkpoint.dir``, which is shared by all
executors.  Only in local mode (tests, a laptop) do we pick one if it is unset.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

# Settings we prefer for sessions we create; ``extra`` overrides them.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Text stages are CPU-bound: keep AQE from merging small shuffles into a
    # handful of tasks (large inputs are far above this size anyway).
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    # Training rows hold long token arrays: a vectorized Parquet batch holds
    # this many rows at once per task, so keep it well below the 4096 default.
    "spark.sql.parquet.columnarReaderBatchSize": "512",
    # Bucketed training tables have one file a bucket (sources.bucketed): their order holds.
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Likewise for Arrow batches (64 MB by default): a task with two Python steps
    # holds one for each, in the JVM and in the worker.
    ARROW_BYTES: "4m",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def get_spark(master: str | None = None, app: str = "dialogprep",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def bound_arrow_batches(spark: SparkSession) -> str | None:
    """Set our Arrow batch size in a session that names none; returns the setting before, for ``restore_arrow_batches``.

    Spark reads it when a query runs, so it can't be bound to one DataFrame.
    """
    before = spark.conf.get(ARROW_BYTES, None)
    if before is None:
        spark.conf.set(ARROW_BYTES, DEFAULT_CONF[ARROW_BYTES])
    return before


def restore_arrow_batches(spark: SparkSession, before: str | None) -> None:
    spark.conf.unset(ARROW_BYTES) if before is None else spark.conf.set(ARROW_BYTES, before)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; set one only if the session has none."""
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: only the session conf is visible
        sc = None
    current = (sc.getCheckpointDir() if sc else None) or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        master = sc.master if sc else spark.conf.get("spark.master", "")
        if not re.match(r"local(\[|$)", master):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="dialogprep-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", current)
        except Exception:  # not a runtime-settable conf here; the context setting below suffices
            pass
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return (sc.getCheckpointDir() if sc else None) or current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint folder."""
    root = ensure_checkpoint_dir(spark)
    return os.path.join(root, "dialogprep", f"{name}-{uuid.uuid4().hex[:12]}")


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a finished scratch folder, wherever the cluster keeps it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
