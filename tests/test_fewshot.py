import random

import pytest
from pyspark.sql import functions as F

from dialogprep.operators import build_prompts, dynamic_few_shot, few_shot_budget, one_shot_example
from dialogprep.schema import PromptConfig, PromptText
from tests.conftest import make_examples

TX = PromptText()


def greedy(base, texts, block, specials=1):
    """Plain restatement of the reference's insertion loop."""
    cur, kept = base, []
    for t in texts:
        c = len(t) + specials
        if cur + c > block:
            break
        cur += c
        kept.append(t)
    return "".join(f"[Example {i + 1}]\n{t}\n\n---\n\n" for i, t in enumerate(kept)), len(kept)


def _pool(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "pos int, text string")


def _base(spark, ex, tok):
    chat = build_prompts(ex, PromptConfig(), None, tok)
    return {r["example_id"]: len(r["source_text"]) + 1 for r in chat.collect()}


@pytest.mark.parametrize("case", ["empty", "first_too_big", "stop_at_misfit", "exact_fit", "base_over"])
def test_edge_cases(spark, tok, case):
    ex = make_examples(spark, [(1, [("A", "hello")], ["kw"], "out")])
    base = _base(spark, ex, tok)[1]
    texts, block = {
        "empty": ([], base + 100),
        "first_too_big": (["x" * 50, "y"], base + 10),
        "stop_at_misfit": (["a" * 5, "b" * 40, "c"], base + 10),
        "exact_fit": (["a" * 4, "b" * 4], base + 10),
        "base_over": (["a"], base - 1),
    }[case]
    cfg = PromptConfig(dynamic_fewshot=True, fewshot_block_size=block)
    out = dynamic_few_shot(ex, _pool(spark, texts) if texts else spark.createDataFrame([], "pos int, text string"),
                           tok, cfg).collect()[0]
    want_prefix, want_k = greedy(base, texts, block)
    assert out["base_tokens"] == base
    assert out["n_examples"] == want_k
    assert out["fewshot_prefix"] == want_prefix
    if case == "stop_at_misfit":
        assert want_k == 1  # "c" would fit but the loop stops at "b"


def test_random_against_restatement(spark, tok):
    rng = random.Random(7)
    recs = [(i, [("A", "w" * rng.randint(0, 60))], ["k"], "o") for i in range(30)]
    ex = make_examples(spark, recs)
    texts = ["t" * rng.randint(0, 40) for _ in range(25)]
    bases = _base(spark, ex, tok)
    block = min(bases.values()) + 200
    cfg = PromptConfig(dynamic_fewshot=True, fewshot_block_size=block)
    got = build_prompts(ex, cfg, _pool(spark, texts), tok).collect()
    for r in got:
        prefix, k = greedy(bases[r["example_id"]], texts, block)
        assert r["n_examples"] == k
        assert r["messages"][0]["content"] == prefix + TX.system


def test_budget_running_total(spark, tok):
    texts = ["a", "bb", "", "dddd"]
    rows = few_shot_budget(_pool(spark, texts), tok).orderBy("pos").collect()
    assert [r["cum_tokens"] for r in rows] == [2, 5, 6, 11]


def test_one_shot_indexes(spark):
    pool = _pool(spark, ["p0", "p1", "p2"])
    df = spark.range(1)

    def get(i):
        return df.select(one_shot_example(pool, i).alias("x")).collect()[0]["x"]

    assert get(0) == TX.one_shot_example
    assert get(1) == "p1"
    assert get(-1) == "p2"
    with pytest.raises(Exception):
        get(5)
