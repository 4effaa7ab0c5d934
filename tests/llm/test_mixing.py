import random
from collections import defaultdict

import pytest

from dialogprep.llm.mixing import mix, mix_plan
from tests.llm.helpers import HARD, clashing, docs, words


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Share by weight, stop at the limit, share the excess again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, free, target = float(sum(sizes.values())), set(order), {}
    while free:
        unit = left / sum(w[s] for s in free)
        above = {s for s in free if unit * w[s] > most * sizes[s]}
        if not above:
            return target | {s: unit * w[s] for s in free}
        for s in above:
            target[s] = float(most * sizes[s])
            left -= target[s]
        free -= above
    return target


def check(rows, plan):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want = brute_targets(sizes)
    assert len(plan) == len(rows)
    for r in plan:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9, abs=1e-6)
        assert 0 <= r["copies"] <= 3
        rate = r["target"] / r["source_size"] if r["source_size"] else 0.0
        assert int(rate) <= r["copies"] <= int(rate) + 1


def test_hard_rows(spark):
    plan = clashing(docs(spark)).transform(mix_plan).collect()
    check(HARD, plan)
    assert [tuple(r) for r in sorted(plan, key=repr)] == [tuple(r) for r in sorted(clashing(docs(spark)).repartition(5).transform(mix_plan).collect(), key=repr)]


def test_many_sources_and_limits(spark):
    rows = [(i, "w " * (1 + i % 50 if i % 9 else 400), "en", f"s{i % 23:02d}" if i % 3 else "s00", 0) for i in range(3000)]
    plan = mix_plan(docs(spark, rows)).collect()
    check(rows, plan)
    near_targets(plan)


def near_targets(plan):
    """Every source is within one document of its target."""
    taken, target, longest = defaultdict(int), {}, defaultdict(int)
    for r in plan:
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]], longest[r["source"]] = r["target"], max(longest[r["source"]], r["size"])
    for s, t in target.items():
        assert abs(taken[s] - t) <= longest[s]


def test_few_long_documents(spark):
    rnd = random.Random(4)
    rows = [(i, "w " * rnd.choice([1, 5, 40, 3000]), "en", f"s{i % 40}" if i % 4 else None, 0) for i in range(400)]
    near_targets(mix_plan(docs(spark, rows)).collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sources_of_the_given_tables(spark, sf):
    near_targets(mix_plan(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).collect())


def test_a_copy_is_as_likely_as_the_fraction(spark):
    """Over many sources of one kind: documents of any place get their copy about equally often."""
    rows = [(i, "w " * (10 + 30 * (i % 3)), "en", f"s{i // 6:04d}", 0) for i in range(2400)]
    got = mix_plan(docs(spark, rows), weights=(1,)).collect()
    assert {r["copies"] for r in got} == {1}
    got = mix_plan(docs(spark, rows), weights=(3, 1)).collect()  # rates of 1.5 and 0.5
    for size in (10, 40, 70):
        extra = [r["copies"] - int(r["rate"]) for r in got if r["size"] == size]
        assert 0.42 < sum(extra) / len(extra) < 0.58


def test_mix_repeats_whole_rows(spark):
    df = clashing(docs(spark))
    got = mix(df)
    assert got.columns == df.columns
    want = sum(r["copies"] for r in mix_plan(df).collect())
    assert got.count() == want


def test_empty(spark):
    assert mix_plan(docs(spark, [])).collect() == []
    assert mix(docs(spark, [])).collect() == []
    only_blank = mix_plan(docs(spark, [(1, "", "en", "a", 0), (2, None, "en", "b", 0)])).collect()
    assert [(r["target"], r["copies"]) for r in only_blank] == [(0.0, 0), (0.0, 0)]
