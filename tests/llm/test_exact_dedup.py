import hashlib
from collections import defaultdict

import pytest

from dialogprep.llm.exact_dedup import drop_copies, exact_groups
from tests.llm.helpers import AZ, HARD, clashing, docs


def low(i):
    return -1 if i is None else i


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(AZ)].append(r[0])
    out = []
    for norm, ids in groups.items():
        keep = max(ids, key=low)
        for n, i in enumerate(sorted(ids, key=low, reverse=True)):
            out.append((i, keep, len(ids), n == 0, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("salts", [None, 1, 2, 50])
def test_equals_brute_force(spark, salts):
    rows = HARD + [(100 + i, "Copy" if i % 2 else "copy", "en", "a", 4) for i in range(300)]
    got = [tuple(r)[:5] for r in clashing(docs(spark, rows)).transform(exact_groups, salts=salts).collect()]
    assert sorted(got, key=repr) == brute(rows)


def test_empty_table(spark):
    assert exact_groups(docs(spark, [])).collect() == []
    assert drop_copies(docs(spark, [])).collect() == []


def test_drop_keeps_whole_rows(spark):
    df = clashing(docs(spark))
    got = drop_copies(df)
    assert got.columns == df.columns
    rows = [tuple(r)[:5] for r in got.collect()]
    assert len(rows) == len({(r[1] or "").translate(AZ) for r in HARD}) == len({(r[1] or "").translate(AZ) for r in rows})
    best = {}
    for r in HARD:
        t = (r[1] or "").translate(AZ)
        if t not in best or low(r[0]) > low(best[t][0]):
            best[t] = r
    assert sorted(rows, key=repr) == sorted(best.values(), key=repr)


def test_one_shared_wide_exchange(spark):
    df = docs(spark, [(i, f"t{i % 7}", "en", "a", 2) for i in range(100)])
    plan = exact_groups(df, salts=4)._jdf.queryExecution().optimizedPlan().toString()
    # A not-null filter in one branch would make the branches differ.
    assert "isnotnull" not in plan


def test_texts_move_once_more_for_the_kept_rows(spark):
    df = docs(spark, [(i, f"t{i % 7}", "en", "a", 2) for i in range(100)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = drop_copies(df)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    # Between the window and the join there is no exchange; the documents' scan has one above it.
    top = plan[:plan.index("SortMergeJoin")]
    assert "Window" in top and "Exchange" not in top
