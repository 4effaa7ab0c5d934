"""Property tests: single-pass rules against plain-Python restatements."""

from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dialogprep.operators import top_keywords

WORDS = st.lists(st.sampled_from(["able", "bake", "cart", "dune", "echo", "fawn"]), max_size=30)


def top2_ref(words):
    c = Counter(words)
    return [w for w, _ in sorted(c.items(), key=lambda kv: (-kv[1], kv[0]))[:2]]


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(WORDS, min_size=1, max_size=20))
def test_top_keywords_matches_counter(spark, batch):
    df = spark.createDataFrame([(i, w) for i, w in enumerate(batch)], "i int, w array<string>")
    got = {r["i"]: r["k"] for r in df.select("i", top_keywords(F.col("w")).alias("k")).collect()}
    assert got == {i: top2_ref(w) for i, w in enumerate(batch)}


def greedy_count(base, costs, block):
    cur, k = base, 0
    for c in costs:
        if cur + c > block:
            break
        cur, k = cur + c, k + 1
    return k


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 60), st.lists(st.integers(0, 20), max_size=12), st.integers(0, 120))
def test_closed_form_equals_greedy(base, costs, block):
    cum, closed = 0, 0
    for c in costs:
        cum += c
        closed += base + cum <= block
    assert closed == greedy_count(base, costs, block)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abé", max_size=4), unique=True, max_size=30), st.integers(1, 10))
def test_rank_by_ranges_equals_sorting(spark, keys, per_range):
    from dialogprep.operators.ordinal import by_range, ordered_index

    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = ordered_index(by_range(df, ["k"], per_range), ["k"], F.col("_range")).collect()
    assert {r["k"]: r["rank"] for r in got} == {k: i for i, k in enumerate(sorted(keys, key=lambda x: x.encode()))}
