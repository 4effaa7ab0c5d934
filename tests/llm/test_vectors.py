"""Top-k search and hard negatives against brute force, with blocks small enough to matter."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialogprep.llm import blocks, hard_negatives, topk

SCHEMA = "vec_id long, embedding array<double>, label int, id string, v int, part int"


def ints(v):
    return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(256 * x) for x in v]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))  # the longer one's rest meets zeros


def order(hit):
    return (-hit[0], hit[1] is None, hit[1] or 0)


def table(seed, n=400, dim=24):
    """Clusters, a third of the rows one vector, repeated ids and rows, nulls, non-finite and short vectors."""
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = centres[i % 6]
        v = centres[0] if i % 3 == 0 else [x + rnd.gauss(0, 0.1) for x in c]
        rows.append((i, v, (i * 7) % 5, "x", i, 0))
    rows += [rows[50], rows[50], (None, centres[1], 1, None, None, None), (None, centres[0], 2, None, None, None), (700, None, 1, "x", 1, 1), (800, [1.0] * 5, 3, "", 0, 0),
             (900, [float("nan")] * dim, 1, "x", 1, 1), (1000, [float("inf")] + [0.0] * (dim - 1), 1, "x", 1, 1), (1100, [None] * dim, 1, "x", 1, 1), (1200, [], 2, "x", 1, 1),
             (1300, centres[2], None, "x", 1, 1), (100, centres[3], 4, "x", 1, 1)]
    rnd.shuffle(rows)
    return rows


def brute_top(rows, k, every):
    v = [(r[0], ints(r[1])) for r in rows if ints(r[1]) is not None]
    out = []
    for i, (q, a) in enumerate(v):
        if q is not None and q % every == 0:
            hits = sorted(((dot(a, b), c) for j, (c, b) in enumerate(v) if j != i), key=order)[:k]
            out += [(q, n, c, s) for n, (s, c) in enumerate(hits, 1)]
    return out


def brute_negatives(rows, n_pos=5, n_neg=5):
    v = [(r[0], ints(r[1]), r[2]) for r in rows if ints(r[1]) is not None and r[2] is not None]
    out = []
    for i, (q, a, la) in enumerate(v):
        if q is None or q % 20:
            continue
        others = [(dot(a, b), c, lb) for j, (c, b, lb) in enumerate(v) if j != i]
        pos = sorted((h for h in others if h[2] == la), key=order)[:n_pos]
        for p in pos:
            neg = sorted((h for h in others if h[2] != la and 80 * p[0] <= 100 * h[0] <= 100 * p[0]), key=order)[:n_neg]
            out += [(q, p[1], n, h[1], p[0], h[0]) for n, h in enumerate(neg, 1)]
    return out


@pytest.fixture
def small(monkeypatch):
    """Blocks of a few rows, so that annuli, slices and tiles are many."""
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 48 * 16)
    monkeypatch.setattr(blocks, "QUERY_BYTES", 48 * 6)
    monkeypatch.setattr(topk, "PIVOTS", 5)
    monkeypatch.setattr(topk, "FIRST", 3)


def same(df, want):
    got = [tuple(r) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_top_k_many_blocks(spark, small):
    rows = table(1)
    df = spark.createDataFrame(rows, SCHEMA)
    same(topk.top_k(df, F.col("vec_id") % 10 == 0).select("query_id", "rank", "id", "score"), brute_top(rows, 5, 10))


def test_top_k_one_block_and_few_rows(spark):
    rows = table(2, 60)
    same(topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, k=80).select("query_id", "rank", "id", "score"), brute_top(rows, 80, 10))


def test_hard_negatives_many_blocks(spark, small):
    rows = table(3)
    df = spark.createDataFrame(rows, SCHEMA)
    same(hard_negatives.mine(df, F.col("vec_id") % 20 == 0, F.col("label")), brute_negatives(rows))


def test_hard_negatives_one_block(spark):
    rows = table(4, 100)
    df = spark.createDataFrame(rows, SCHEMA)
    same(hard_negatives.mine(df, F.col("vec_id") % 20 == 0, F.col("label"), n_pos=3, n_neg=2), brute_negatives(rows, 3, 2))


@pytest.mark.parametrize("rows", [[], [(1, [0.5], 1, "", 1, 1)], [(100, [0.5], 1, "", 1, 1)], [(100, None, 1, "", 1, 1)]])
def test_empty_and_lonely(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert topk.top_k(df, F.col("vec_id") % 50 == 0).count() == 0
    assert hard_negatives.mine(df, F.col("vec_id") % 100 == 0, F.col("label")).count() == 0


def test_too_large_fails(spark):
    df = spark.createDataFrame([(0, [1e9], 1, "", 1, 1)], SCHEMA)
    with pytest.raises(ValueError, match="2\\^56"):
        topk.top_k(df, F.col("vec_id") == 0)


def test_wide_integers_are_exact(spark):
    rows = [(i, [float(2 ** 19 + i), float(2 ** 19 - 3 * i)], i % 2, "", 0, 0) for i in range(30)]
    same(topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0).select("query_id", "rank", "id", "score"), brute_top(rows, 5, 10))


def test_bounds_hold():
    """Pivot bounds and segment bounds never rule out a true score."""
    rng = np.random.default_rng(5)
    v = np.floor(rng.normal(0, 80, (300, 40)))
    norm2 = float((v * v).sum(1).max())
    x = topk.lift(v, norm2)
    pivots = topk.fit_pivots(x, 7)
    d, near = topk.distances(x, pivots), topk.distances(x, pivots).argmin(1)
    q = np.c_[v[:50], np.zeros(50)]
    true = np.sqrt(((q[:, None] - x[None]) ** 2).sum(2))
    for i in range(50):
        low = np.abs(topk.distances(q[i:i + 1], pivots)[0][near] - d[np.arange(300), near])
        assert (low <= true[i] + topk.slack(norm2)).all()
    levels = hard_negatives.summarise(v)
    back = hard_negatives.load(hard_negatives.stored(v), 300, 40)
    s, slack = v @ v.T, hard_negatives.slack(norm2)
    widths = []
    for (am, ad), (cm, cd) in zip(levels, back, strict=True):
        mid, off = am @ cm.T, ad @ cd.T + slack
        assert ((mid - off <= s) & (s <= mid + off)).all()
        widths.append(off.mean())
    assert widths == sorted(widths, reverse=True)  # finer segments, tighter bounds
