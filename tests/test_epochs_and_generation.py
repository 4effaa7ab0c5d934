"""Shuffled orders as formulas, fixed batches, token budgets, and a generation that goes on after a crash."""

import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from dialogprep.functions.permutation import Permutation
from dialogprep.operators import epoch_order, epoch_rows, few_shot_prefix, generate_resumable, map_batches
from dialogprep.operators.generate import regrouped, token_batches


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 97, 101, 1000, 1023, 4097])
def test_a_bijection_and_its_inverse(spark, n):
    p = Permutation(n, 7, 1)
    rows = spark.range(n).select("id", p.rank(F.col("id")).alias("r")).withColumn("back", p.position(F.col("r"))).collect()
    assert sorted(r.r for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)


def test_large_n_comes_back(spark):
    for n in (10 ** 9 + 7, 10 ** 13 + 37, 2 ** 52):
        p = Permutation(n)
        assert p.n <= p.a * p.b < p.n + 4 * p.a
        d = spark.range(2000).select((F.col("id") * (n // 2000)).alias("id"))
        d = d.withColumn("r", p.rank(F.col("id"))).withColumn("back", p.position(F.col("r")))
        assert d.filter(f"back <> id OR r < 0 OR r >= {n}").isEmpty()
        low = d.filter(F.col("r") < n // 2).count()
        assert 850 < low < 1150  # spread over the range


def test_epochs_differ_and_are_mixed(spark):
    n = 500
    d = spark.range(n).withColumnRenamed("id", "pos")
    orders = [[r.pos for r in epoch_order(d, n, seed=1, epoch=e).orderBy("shuffle_rank").collect()] for e in range(3)]
    assert len({tuple(o) for o in orders}) == 3
    for o in orders:
        assert sum(abs(a - b) == 1 for a, b in zip(o, o[1:], strict=False)) < 20
    assert [r.pos for r in epoch_order(d, n, seed=1).orderBy("shuffle_rank").collect()] == orders[0]


def test_restart_in_the_middle(spark):
    n = 200
    d = spark.range(n).withColumnRenamed("id", "pos").repartition(7)
    whole = [r.pos for r in epoch_order(d, n, epoch=4).orderBy("shuffle_rank").collect()]
    rest = epoch_rows(d, n, 120, 150, epoch=4)
    assert [r.pos for r in rest.orderBy("shuffle_rank").collect()] == whole[120:150]
    assert epoch_rows(d, n, 190, epoch=4).count() == 10
    plan = rest._jdf.queryExecution().executedPlan().toString().split("Exchange")[0]
    assert "Sort" not in plan and "Window" not in plan


def test_positions_are_checked(spark):
    for bad in (spark.range(5, 6), spark.range(1).select(F.lit(None).cast("long").alias("id"))):
        with pytest.raises(Exception, match="not a position"):
            epoch_order(bad, 5, "id").collect()
    with pytest.raises(ValueError):
        Permutation(0)


@pytest.mark.parametrize("arrow", [7, 10_000])
def test_fixed_batches_whatever_arrow_sends(spark, arrow):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(arrow))
    try:
        def numbered(pdf):
            return pd.DataFrame({"first": [pdf["id"].iloc[0]], "n": [len(pdf)], "index": [pdf.index[-1]]})

        got = map_batches(spark.range(0, 250, 1, 1), numbered, "first long, n long, index long", batch_rows=60).collect()
        assert [tuple(r) for r in got] == [(0, 60, 59), (60, 60, 59), (120, 60, 59), (180, 60, 59), (240, 10, 9)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_regrouped_equals_slices():
    rnd = random.Random(2)
    for size in (1, 3, 8, 100):
        parts, n = [], 0
        for k in [rnd.randint(0, 9) for _ in range(12)]:
            parts.append(pd.DataFrame({"x": range(n, n + k)}))
            n += k
        got = [list(p["x"]) for p in regrouped(iter(parts), size)]
        assert got == [list(range(i, min(i + size, n))) for i in range(0, n, size)]
    assert list(regrouped(iter([]), 4)) == []


def test_token_batches():
    rnd = random.Random(3)
    for _ in range(50):
        lengths = [rnd.randint(0, 40) for _ in range(rnd.randint(0, 30))]
        cuts = list(token_batches(lengths, 5, 64))
        assert [i for a, b in cuts for i in range(a, b)] == list(range(len(lengths)))
        for a, b in cuts:
            assert b - a <= 5 and (max(lengths[a:b]) * (b - a) <= 64 or b - a == 1)
        for (a, b), (_, z) in zip(cuts, cuts[1:], strict=False):  # no batch could take one more
            assert b - a == 5 or max(lengths[a:b + 1]) * (b + 1 - a) > 64
    assert list(token_batches([9, 9, 9], 2, None)) == [(0, 2), (2, 3)]


def test_generation_goes_on_after_a_crash(spark, tmp_path):
    """The first run dies in a step; the second one generates no prompt of a committed step again."""
    calls, fuse, work = str(tmp_path / "calls"), str(tmp_path / "fuse"), str(tmp_path / "work")
    os.makedirs(calls)
    open(fuse, "w").close()
    df = spark.range(0, 40, 1, 1).select(F.col("id").alias("example_id"), F.array(F.lit(1), (F.col("id") + 16).cast("int")).alias("source_ids"))

    def factory():
        def gen(prompts):
            for p in prompts:
                if p[1] == 16 + 27 and os.path.exists(fuse):
                    raise RuntimeError("executor lost")
                with open(f"{calls}/{p[1] - 16}", "a") as f:
                    f.write("x")
            return [[*p, 2] for p in prompts]

        return gen

    run = lambda: generate_resumable(df, factory, work, rows_per_file=5, files_per_step=2, batch_size=3)
    with pytest.raises(Exception, match="executor lost"):
        run()
    made = {int(n): len(open(f"{calls}/{n}").read()) for n in os.listdir(calls)}
    committed = {r.example_id for r in spark.read.parquet(f"{work}/out").collect()}
    assert committed and 27 not in committed and committed <= set(made)
    os.unlink(fuse)
    got = run()
    assert sorted((r.example_id, list(r.out_ids)) for r in got.collect()) == [(i, [1, 16 + i, 2]) for i in range(40)]
    after = {int(n): len(open(f"{calls}/{n}").read()) for n in os.listdir(calls)}
    assert all(after[i] == made[i] for i in committed)
    assert run().count() == 40  # finished: nothing is generated again
    assert {int(n): len(open(f"{calls}/{n}").read()) for n in os.listdir(calls)} == after


def test_budget_table_equals_greedy(spark, tok):
    texts = ["aaaa", "b", "cc" * 9, "", "ddd" * 5, "e"]
    for texts_, block in ((texts, 30), (texts, 1), ([], 10), (["x" * 50], 10), (texts, 200)):
        pool = spark.createDataFrame(list(enumerate(texts_)), "pos int, text string")
        t = spark.range(1).select(few_shot_prefix(pool, tok, block).alias("t")).select("t.*").collect()[0]
        assert len(t.fits) == block + 1
        for left in range(block + 1):
            n, used = 0, 0
            for x in texts_:
                if used + len(x) + 1 > left:
                    break
                n, used = n + 1, used + len(x) + 1
            assert t.fits[left] == n
        assert len(t.ends) == max(t.fits) + 1 and t.ends[-1] == len(t.text) and t.ends[0] == 0
