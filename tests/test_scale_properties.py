"""Partition independence, streaming parity and plan shape."""

import os

import pytest
from pyspark.sql import functions as F

from dialogprep.plans import registry as R
from dialogprep.streaming import prepare_stream

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def _sft_rows(spark, turns):
    from dialogprep.operators import build_prompts, encode_examples, examples_from_turns
    from dialogprep.functions import checksum

    e = encode_examples(build_prompts(examples_from_turns(turns), R.CFG, None, R.TOK), R.TOK)
    return sorted((r[0], r[1], r[2]) for r in e.select("example_id", checksum(F.col("input_ids")),
                                                        checksum(F.col("labels"))).collect())


def test_partition_independence(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    base = _sft_rows(spark, turns)
    for n in (1, 4, 16):
        assert _sft_rows(spark, turns.repartition(n)) == base
    assert _sft_rows(spark, turns.orderBy(F.desc("conv_id"), F.desc("turn"))) == base


def test_streaming_parity(spark):
    from dialogprep.operators import encode_examples, build_prompts
    from dialogprep.session import scratch_path

    ex = R.examples(spark, SF)
    src = scratch_path(spark, "test_stream_src")
    ex.write.parquet(src)
    batch = encode_examples(build_prompts(ex, R.CFG, None, R.TOK), R.TOK)
    from dialogprep.schema import EXAMPLE_SCHEMA

    stream = spark.readStream.schema(EXAMPLE_SCHEMA).parquet(src)
    rows = prepare_stream(stream, R.CFG, R.TOK).select("example_id", "input_ids", "labels")
    q = rows.writeStream.format("memory").queryName("stream_parity").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.sql("SELECT * FROM stream_parity").collect())
    want = sorted(tuple(r) for r in batch.select("example_id", "input_ids", "labels").collect())
    assert got == want


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_native_operators_have_no_python(spark):
    for name in ("sft_examples", "dynamic_few_shot", "collate_pad", "pack_tokens", "tokenize", "preference_truncate"):
        plan = _plan(R.QUERIES[f"{name}"] if False else getattr(R, f"q_{name}")(spark, SF))
        assert "EvalPython" not in plan and "PythonUDF" not in plan, name


def test_flagship_has_one_exchange(spark):
    plan = _plan(R.q_sft_examples(spark, SF))
    assert plan.count("Exchange hashpartitioning") == 1


def test_few_shot_pool_is_a_subquery_not_a_join(spark):
    plan = _plan(R.q_dynamic_few_shot(spark, SF))
    assert "Subquery" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def _collect_sorted(df):
    return sorted(tuple(r) for r in df.collect())


def test_ranked_operators_partition_independent(spark):
    from dialogprep.operators import collate, pack, shuffle, split_exact

    e = R._encoded(spark, SF).select("example_id", "input_ids", "labels", "attention_mask").cache()
    outs = []
    for n in (1, 5, 16):
        d = e.repartition(n)
        outs.append((
            _collect_sorted(collate(d, 3, R.TOK.pad_token_id).select("example_id", "batch_id", "ids", "mask")),
            _collect_sorted(pack(d, 300, group_rows=4).select("group", "chunk", "input_ids")),
            _collect_sorted(split_exact(d, "example_id", 0.2).select("example_id", "split")),
            _collect_sorted(shuffle(d, "example_id", 5).select("example_id", "shuffle_rank")),
        ))
    assert outs[0] == outs[1] == outs[2]


def test_spread_only_when_asked(spark):
    from dialogprep.operators import spread

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan(spread(docs))
    assert "Repartition" in plan(spread(docs, 3)) and spread(docs, 3).count() == docs.count()
    spark.conf.set("spark.dialogprep.spreadPartitions", "4")
    try:
        assert "Repartition" in plan(spread(docs))
    finally:
        spark.conf.unset("spark.dialogprep.spreadPartitions")
