"""Batching and packing over a bucketed table: same rows, and no token array moves for a join."""

import random

import pytest
from pyspark.sql import functions as F

from dialogprep.operators import collate, pack
from dialogprep.plans.training import bucket_split, packed_blocks, training_batches
from dialogprep.session import scratch_path
from dialogprep.sources import open_bucketed, write_bucketed
from dialogprep.sources.bucketed import buckets_by

B = 8


def rows(spark, n=120):
    rnd = random.Random(7)
    data = [(f"k{i:04d}", i % 2, [rnd.randint(16, 99) for _ in range(rnd.randint(0, 20))]) for i in range(n)]
    d = spark.createDataFrame(data, "example_id string, task_order int, input_ids array<int>")
    return d.select("example_id", F.lit(0).alias("origin"), F.lit("train").alias("split"), "task_order", "input_ids", F.transform("input_ids", lambda x: -x).alias("labels"),
                    F.transform("input_ids", lambda x: F.lit(1)).alias("attention_mask"))


@pytest.fixture
def table(spark):
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.legacy.bucketedTableScan.outputOrdering")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    src = rows(spark)
    yield src, bucket_split(src, scratch_path(spark, "bucketed_test"), buckets=5)
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def nodes(plan, names):
    """Nodes of a plan whose class is in ``names``."""
    kids = plan.children()
    inner = [plan.executedPlan()] if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else [kids.apply(i) for i in range(kids.size())]
    return [plan] * (plan.getClass().getSimpleName() in names) + [n for k in inner for n in nodes(k, names)]


def moved(df, *columns):
    """How many exchanges carry one of the columns."""
    found = nodes(df._jdf.queryExecution().executedPlan(), {"ShuffleExchangeExec"})
    out = [{x.split("#")[0].strip() for x in n.output().mkString(",").split(",")} for n in found]
    return sum(bool(o & set(columns)) for o in out)


def scanned_under_exchange(df, column):
    found = nodes(df._jdf.queryExecution().executedPlan(), {"ShuffleExchangeExec"})
    return sum(f"{column}:" in s.metadata().mkString(" ") for e in found for s in nodes(e, {"FileSourceScanExec"}))


def same(a, b):
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.select(a.columns).collect()))


def test_collate_equals_plain_and_moves_nothing(spark, table):
    src, bucketed = table
    got = training_batches(bucketed, 4, 2, n_shards=2)
    same(training_batches(src, 4, 2, n_shards=2), got.drop("n_tokens"))
    assert moved(got, "input_ids", "labels", "attention_mask") == 0
    assert scanned_under_exchange(got, "input_ids") == 0
    assert len(nodes(got._jdf.queryExecution().executedPlan(), {"FileSourceScanExec"})) >= 2
    wide = [s for s in nodes(got._jdf.queryExecution().executedPlan(), {"SortExec"}) if "labels" in s.output().mkString(",")]
    assert not wide  # the buckets' order holds


def test_pack_equals_plain_and_moves_only_pieces(spark, table):
    src, bucketed = table
    got = packed_blocks(bucketed, B, group_rows=10)
    same(packed_blocks(src, B, group_rows=10), got)
    assert moved(got, "input_ids", "labels", "attention_mask") == 0
    assert scanned_under_exchange(got, "input_ids") == 1  # the regrouping of the pieces by chunk


def test_plain_table_does_move(spark, table):
    src, _ = table
    path = scratch_path(spark, "plain_test")
    src.write.parquet(path)
    assert moved(collate(spark.read.parquet(path), 4, 2, key=["origin", "example_id", "task_order"]), "labels") > 0


def test_opened_again(spark, table):
    src, _ = table
    path = scratch_path(spark, "bucketed_again")
    write_bucketed(src, path, ["example_id"])
    again = open_bucketed(spark, path)
    same(src, again)
    assert again.schema == src.schema or [f.name for f in again.schema] == src.columns
    assert buckets_by(again, ["example_id"]) == 1 and buckets_by(again, ["task_order"]) is None and buckets_by(src, ["example_id"]) is None


def test_keys_are_checked(spark, table):
    src, _ = table
    twice = write_bucketed(src.unionByName(src), scratch_path(spark, "bucketed_twice"), "example_id", 3)
    with pytest.raises(Exception, match="repeated row key"):
        collate(twice, 4, 2).collect()


def group_texts(columns, block):
    """Plain restatement: every column joined, all cut at the first one's offsets."""
    cat = {c: [x for row in rows for x in row] for c, rows in columns.items()}
    total = len(next(iter(cat.values())))
    total = total // block * block if total >= block else total
    return [{c: v[i:i + block] for c, v in cat.items()} for i in range(0, total, block)]


@pytest.mark.parametrize("seed", range(4))
def test_unequal_columns(spark, seed):
    rnd = random.Random(seed)
    n = lambda top: [rnd.randint(0, 99) for _ in range(rnd.randint(0, top))]
    data = [(i, n(9), n(3 + 9 * (seed % 2)), n(2) if seed < 3 else []) for i in range(23)]
    if seed == 2:
        data = [(i, a[:1] if i == 5 else [], b, c) for i, a, b, c in data]  # one token in the first column
    df = spark.createDataFrame(data, "example_id long, a array<int>, b array<int>, c array<int>")
    got = {(r.group, r.chunk): {c: r[c] for c in "abc"} for r in pack(df, 6, group_rows=8, cols=("a", "b", "c"), unequal="cut").collect()}
    want = {}
    for g in range(0, 23, 8):
        part = data[g:g + 8]
        for k, chunk in enumerate(group_texts({c: [r[i] for r in part] for i, c in enumerate("abc", 1)}, 6)):
            want[g // 8, k] = chunk
    assert got == want


def test_null_and_empty_arrays(spark):
    df = spark.createDataFrame([(1, [1, 2], None), (2, None, [5]), (3, [], [6, 7, 8])], "example_id long, a array<int>, b array<int>")
    assert [tuple(r) for r in pack(df, 2, cols=("a", "b"), unequal="cut").collect()] == [(0, 0, [1, 2], [5, 6])]
