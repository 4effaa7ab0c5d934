"""The exact split by radix selection: a predicate, exact at any bucket width, ties included."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from dialogprep.operators import preferences as P


def order(keys, seed=42):
    return sorted(keys, key=lambda k: (hashlib.md5(f"split|{seed}|{'|'.join(map(str, k))}".encode()).hexdigest(), k))


@pytest.mark.parametrize("digits,few", [(4, 10_000), (1, 1), (2, 3), (16, 0)])
def test_equals_sorting(spark, monkeypatch, digits, few):
    monkeypatch.setattr(P, "RADIX_DIGITS", digits)
    monkeypatch.setattr(P, "FEW", few)
    rnd = random.Random(digits)
    keys = [(f"{rnd.randint(0, 9)}-{i}", i % 3) for i in range(300)]
    df = spark.createDataFrame([(*k, "row") for k in keys], "a string, b int, c string").repartition(5)
    for size in (0.01, 0.1, 0.5, 7, 299):
        n = size if size >= 1 else math.ceil(len(keys) * size)
        got = {(r.a, r.b) for r in P.split_exact(df, ["a", "b"], size).filter("split = 'test'").collect()}
        assert got == set(order(keys)[:n])


def test_borders(spark):
    df = spark.range(10)
    count = lambda size: P.split_exact(df, "id", size).filter("split = 'test'").count()
    assert [count(s) for s in (0.0, 0.05, 0.1, 0.99, 10, 11)] == [0, 1, 1, 10, 10, 10]
    assert P.split_exact(df.limit(0), "id", 0.5).count() == 0


def test_no_window_join_or_shuffle(spark):
    plan = P.split_exact(spark.range(1000).withColumn("wide", F.lit("w")), "id", 0.1)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Window", "Join", "Sort"))


def test_repeated_and_null_keys(spark):
    keys = [(k,) for k in range(20)]
    by = [k for (k,) in order(keys)]
    rows = [(k,) for k in [*range(20), by[2], by[9]]]  # copies off the border are harmless
    got = P.split_exact(spark.createDataFrame(rows, "id long"), "id", 6, check_keys=False).filter("split = 'test'")
    assert sorted(r.id for r in got.collect()) == sorted([*by[:5], by[2]])
    with pytest.raises(ValueError, match="one key"):
        P.split_exact(spark.createDataFrame(rows, "id long"), "id", 3, check_keys=False)
    with pytest.raises(ValueError, match="repeated row key"):
        P.split_exact(spark.createDataFrame(rows, "id long"), "id", 6)
    with pytest.raises(Exception, match="null in the row key"):
        P.split_exact(spark.createDataFrame([(1,), (None,)], "id long"), "id", 1).collect()


def test_many_rows_of_one_hash(spark, monkeypatch):
    monkeypatch.setattr(P, "FEW", 2)
    df = spark.createDataFrame([(1,)] * 50 + [(2,)], "id long")
    first = [k for (k,) in order([(1,), (2,)])]
    n = 50 if first[0] == 1 else 1
    assert P.split_exact(df, "id", n, check_keys=False).filter("split = 'test'").count() == n
    with pytest.raises(ValueError, match="one key"):
        P.split_exact(df, "id", n - 1 if n > 1 else 2, check_keys=False)
