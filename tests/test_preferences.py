import math

import pytest
from pyspark.sql import functions as F

from dialogprep.operators import filter_by_length, shuffle, split_exact, split_hash, truncate_preferences


def _prefs(spark, rows):
    return spark.createDataFrame(rows, "example_id long, prompt string, chosen string, rejected string")


def test_length_filter_boundaries(spark):
    rows = [(1, "a" * 4, "b" * 6, "c" * 6),   # exactly at the cutoff: kept
            (2, "a" * 4, "b" * 6, "c" * 7),   # only rejected too long: dropped
            (3, "a" * 4, "b" * 7, "c" * 1)]
    got = sorted(r["example_id"] for r in filter_by_length(_prefs(spark, rows), 10).collect())
    assert got == [1]


def test_length_filter_on_arrays(spark):
    df = spark.createDataFrame([(1, ["x", "y"], "abc", "d")], "example_id long, prompt array<string>, chosen string, rejected string")
    assert filter_by_length(df, 5).count() == 1 and filter_by_length(df, 4).count() == 0


def trunc_ref(p, c, r, ml, mp):
    p, c, r = [1] + p, c + [2], r + [2]
    longer = max(len(c), len(r))
    if len(p) + longer > ml:
        p = p[-mp:]
    if len(p) + longer > ml:
        c, r = c[:ml - mp], r[:ml - mp]
    return p, c, r


@pytest.mark.parametrize("lp,lc,lr", [(3, 2, 2), (30, 2, 2), (3, 30, 5), (30, 30, 30)])
def test_truncation_matches_rule(spark, tok, lp, lc, lr):
    ml, mp = 20, 12
    row = (1, "p" * lp, "c" * lc, "r" * lr)
    got = truncate_preferences(_prefs(spark, [row]), tok, ml, mp).collect()[0]
    enc = lambda s: [ord(x) + 16 for x in s]
    assert (got["prompt_ids"], got["chosen_ids"], got["rejected_ids"]) == trunc_ref(enc(row[1]), enc(row[2]), enc(row[3]), ml, mp)


@pytest.mark.parametrize("n,frac", [(1, 0.01), (100, 0.07), (37, 0.1), (10, 3)])
def test_split_exact_sizes(spark, n, frac):
    df = spark.range(n).withColumnRenamed("id", "k")
    s = split_exact(df, "k", frac, seed=42)
    n_test = s.filter(F.col("split") == "test").count()
    assert n_test == (int(frac) if frac >= 1 else math.ceil(n * frac))
    assert s.count() == n


def test_split_hash_stable_and_disjoint(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    a = {r["k"]: r["split"] for r in split_hash(df, "k", 0.2).collect()}
    b = {r["k"]: r["split"] for r in split_hash(df.filter("k < 250"), "k", 0.2).collect()}
    assert all(a[k] == v for k, v in b.items())
    assert 40 < sum(v == "test" for v in a.values()) < 160


def test_shuffle_is_a_permutation_and_deterministic(spark):
    df = spark.range(200).withColumnRenamed("id", "k")
    r1 = [r["k"] for r in shuffle(df, "k", 1).orderBy("shuffle_rank").collect()]
    r2 = [r["k"] for r in shuffle(df.repartition(7), "k", 1).orderBy("shuffle_rank").collect()]
    assert r1 == r2 and sorted(r1) == list(range(200)) and r1 != list(range(200))
    ranks = sorted(r["shuffle_rank"] for r in shuffle(df, "k", 1).collect())
    assert ranks == list(range(200))


def test_rank_with_shared_hash_prefixes(spark):
    """Many keys in one hash-prefix bucket: ranks still follow (hash, key) order."""
    import hashlib

    from dialogprep.operators import hash_prefix_bucket, ordered_index
    from dialogprep.operators.preferences import hash_key

    df = spark.range(300).withColumnRenamed("id", "k").withColumn("_h", hash_key(F.col("k"), 7, "split"))
    ranked = ordered_index(df, ["_h", "k"], hash_prefix_bucket(F.col("_h"), digits=1), rank_col="r")
    got = [r["k"] for r in ranked.orderBy("r").collect()]
    want = sorted(range(300), key=lambda k: (hashlib.md5(f"split|7|{k}".encode()).hexdigest(), k))
    assert got == want
    assert sorted(r["r"] for r in ranked.collect()) == list(range(300))
