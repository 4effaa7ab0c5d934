"""User functions over a table: batched maps (U1) and text generation (U4).

Both run as ``mapInPandas``: rows travel in Arrow batches, the user function is
built once per Python worker stream, and every input column passes through, so
predictions stay next to their records without a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialogprep.functions import ids as I
from dialogprep.functions.tokens import IDS_TYPE


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame],
                schema: T.StructType | str, batch_rows: int | None = None) -> DataFrame:
    """Apply ``fn`` to batches; it may change the row count.

    Without ``batch_rows`` a batch is what Arrow sends.  With it every batch has
    just that many consecutive rows of its partition (the last one what is left),
    whatever Arrow sends, as in the reference, whose map function sees batches
    of a fixed size.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches if batch_rows is None else regrouped(batches, batch_rows):
            yield fn(pdf)

    return df.mapInPandas(run, schema)


def regrouped(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """The same rows in the same order, ``size`` at a time; holds less than one batch and what came last."""
    if size < 1:
        raise ValueError(f"batches of {size} rows")
    held: list[pd.DataFrame] = []
    n = 0
    for pdf in batches:
        at = 0
        while n + len(pdf) - at >= size:
            take = size - n
            part = [*held, pdf.iloc[at:at + take]]
            yield (part[0] if len(part) == 1 else pd.concat(part)).reset_index(drop=True)
            held, n, at = [], 0, at + take
        if at < len(pdf):
            held.append(pdf.iloc[at:])
            n += len(pdf) - at
    if n:
        yield pd.concat(held).reset_index(drop=True)


def token_batches(lengths: list[int], batch_size: int, token_budget: int | None) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows: at most ``batch_size``, and padded to the longest at most ``token_budget`` tokens.

    A row longer than the budget is a batch of its own.
    """
    a, longest = 0, 0
    for i, n in enumerate(lengths):
        now = max(longest, n)
        if i > a and (i - a >= batch_size or (token_budget and now * (i - a + 1) > token_budget)):
            yield a, i
            a, now = i, n
        longest = now
    if a < len(lengths):
        yield a, len(lengths)


def generate_column(df: DataFrame, fn_factory: Callable[[], Callable[[list], list]],
                    prompt_col: str = "source_ids", out_col: str = "out_ids",
                    batch_size: int = 8, token_budget: int | None = None, profile=None) -> DataFrame:
    """U4: add ``out_col`` = generator output ids for every row.

    ``fn_factory()`` is called once per worker stream and returns a function
    that maps a list of prompt id lists to a list of full output id lists
    (prompt followed by the generated ids, as causal-LM generation returns).
    A call has at most ``batch_size`` prompts and, padded to the longest, at
    most ``token_budget`` tokens.  ``profile`` is a
    ``pyspark.resource.ResourceProfile`` for the stage: executors with
    accelerators for the generator only.
    """
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, IDS_TYPE)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = fn_factory()
        for pdf in batches:
            for a, b in token_batches([len(p) for p in pdf[prompt_col]], batch_size, token_budget):
                part = pdf.iloc[a:b].copy()
                part[out_col] = [np.asarray(o, dtype=np.int32) for o in fn([list(p) for p in part[prompt_col]])]
                yield part  # a batch's outputs leave before the next is generated

    return df.mapInPandas(run, schema, profile=profile)


def generate_resumable(df: DataFrame, fn_factory: Callable[[], Callable[[list], list]], work: str, rows_per_file: int = 1000,
                       files_per_step: int = 64, **generate) -> DataFrame:
    """U4 as a job that goes on where it stopped: ``generate_column`` over ``df`` with a log of what is finished.

    The prompts are written once under ``work``, in files of about ``rows_per_file``
    rows.  A file stream takes ``files_per_step`` of them at a time; the sink
    commits a step's outputs as one, and the stream's checkpoint is the log of
    finished files.  A lost executor repeats its task only.  A second call with
    the same ``work`` after a crash generates the files of unfinished steps only, and
    after a finished run nothing.  ``work`` belongs to one ``df``: a second call
    does not look at it again.
    """
    spark = df.sparkSession
    prompts, log, out = f"{work}/prompts", f"{work}/log", f"{work}/out"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{prompts}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(prompts)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files_per_step).parquet(prompts)
    made = generate_column(stream, fn_factory, **generate)
    query = made.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(made.schema).parquet(out)  # the sink's own log names the committed files


def decode_prediction(df: DataFrame, tokenizer, out_col: str = "out_ids",
                      prompt_col: str = "source_ids", predict_col: str = "predict") -> DataFrame:
    """C10 + C9: keep only the continuation and decode it without specials."""
    cont = I.continuation(F.col(out_col), F.col(prompt_col))
    return df.withColumn(predict_col, tokenizer.decode(cont, skip_special=True))


def join_predictions(records: DataFrame, preds: DataFrame, key: str = "example_id") -> DataFrame:
    """Predictions next to their records by key (left join keeps every record)."""
    return records.join(preds, on=key, how="left")


def with_prediction(df: DataFrame, predict_col: str = "predict", replace_output: bool = False) -> DataFrame:
    """Keep ``predict`` as its own field, or write it into ``output``."""
    if replace_output:
        return df.withColumn("output", F.col(predict_col)).drop(predict_col)
    return df
