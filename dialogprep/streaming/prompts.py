"""Row-wise preparation on a stream of dialogue records.

The reference reads finite files only; what carries over to streams is that
prompt rendering, tokenisation and label masking are deterministic per-row
Column expressions.  A file-source stream of nested records therefore goes
through exactly the batch operators, and an ``availableNow`` trigger turns
"process what has arrived" into an incremental batch job with a checkpoint
(exactly-once file sink, restartable after a failure).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dialogprep.operators.examples import encode_examples, to_training_table
from dialogprep.operators.prompting import build_prompts
from dialogprep.schema import EXAMPLE_SCHEMA, PromptConfig

ROW_WISE_MODES = ("chat", "one_shot", "tapt", "instruction")


def prepare_stream(stream: DataFrame, cfg: PromptConfig, tokenizer) -> DataFrame:
    """Training rows for a streaming DataFrame of records (row-wise modes only)."""
    if cfg.mode not in ROW_WISE_MODES or (cfg.one_shot and cfg.oneshot_idx != 0):
        raise ValueError(f"mode {cfg.mode!r} needs a pool lookup; use the batch path")
    return encode_examples(build_prompts(stream, cfg, None, tokenizer), tokenizer)


def stream_training_rows(spark: SparkSession, src: str, out: str, cfg: PromptConfig, tokenizer,
                         checkpoint: str, fmt: str = "parquet") -> DataFrame:
    """Process every record file that has arrived under ``src`` into ``out``.

    Returns the sink read back as a batch DataFrame (key, source and model ids).
    """
    stream = spark.readStream.schema(EXAMPLE_SCHEMA).format(fmt).load(src)
    rows = prepare_stream(stream, cfg, tokenizer)
    q = (to_training_table(rows, extra=("source_ids",)).writeStream.format("parquet")
         .option("checkpointLocation", checkpoint).option("path", out)
         .trigger(availableNow=True).outputMode("append").start())
    q.awaitTermination()
    return spark.read.parquet(out)
