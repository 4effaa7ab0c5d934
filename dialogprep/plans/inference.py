"""Batch inference: prompts -> generator -> continuation -> records with predictions.

One scan of the records (the reference reads the file twice); the generator
runs in Arrow batches with every record column passed through, so the
prediction lands next to its record without a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialogprep.operators.generate import decode_prediction, generate_column, with_prediction
from dialogprep.operators.prompting import build_prompts
from dialogprep.schema import PromptConfig
from dialogprep.sources.readers import load_examples
from dialogprep.sources.writers import materialize, write_document, write_predictions, write_submission

INFERENCE_CONFIG = PromptConfig(one_shot=True, oneshot_idx=0)


def predict(records: DataFrame, fn_factory, tokenizer, cfg: PromptConfig = INFERENCE_CONFIG,
            batch_size: int = 8) -> DataFrame:
    """Records plus ``predict`` (decoded continuation, special tokens skipped)."""
    cols = records.columns
    prompts = build_prompts(records, cfg, None, tokenizer)
    prompts = prompts.select(*cols, tokenizer.encode(F.col("source_text"), add_special=True).alias("source_ids"))
    out = decode_prediction(generate_column(prompts, fn_factory, batch_size=batch_size), tokenizer)
    return out.select(*cols, "predict")


def run_inference(spark: SparkSession, data_path: str, output_path: str, fn_factory, tokenizer,
                  do_submit: bool = False, key: str = "example_id", fmt: str = "json",
                  multi_line: bool = True, batch_size: int = 8, schema: T.StructType | None = None,
                  max_rejects: int = 0, reject_path: str | None = None, as_json_array: bool = True,
                  as_document: bool = False) -> DataFrame:
    """Write predictions (JSON Lines with ``predict``) or a submission; return the records written.

    A submission replaces ``output`` and keeps the records in source order, as
    one JSON array over ordered parts (``as_json_array``), JSON Lines, or
    one indented file (``as_document``).  A key that the records did not have
    orders them and is not written.
    """
    records, own_key = load_examples(spark, data_path, fmt, multi_line, schema, key, max_rejects, reject_path)
    pred = materialize(predict(records, fn_factory, tokenizer, batch_size=batch_size), "predictions", spark)
    out = with_prediction(pred, replace_output=do_submit)
    helper = () if own_key else (key,)
    if do_submit and as_document:
        write_document(out, output_path, order_col=key, materialized=True, drop=helper)
    elif do_submit:
        write_submission(out, output_path, order_col=key, as_json_array=as_json_array, materialized=True, drop=helper)
    else:
        write_predictions(out.drop(*helper), output_path)
    return out.drop(*helper)
