import math
from collections import Counter

import numpy as np
import pytest

from dialogprep.llm.quality_rules import js_distance, rate_documents
from tests.llm.helpers import HARD, clashing, docs, words


def brute(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    win = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    n = Counter(win)
    covered = {i + k for i, x in enumerate(win) if n[x] > 1 for k in range(5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def test_base_equals_brute_force(spark):
    extra = [(50, "a b c d e f a b c d e g h i j k l m n o p q r s t u v w x y z 1 2 3 4 5 6 7 8", "en", "s", 0),
             (51, "same same same same same same", "en", "s", 0), (52, "l 1\nl 1\n\n \nl 2\nl 1 <b>#*|%</b>", "en", "s", 0)]
    rows = HARD + extra
    got = clashing(docs(spark, rows)).transform(rate_documents).select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(((r[0], *brute(r[1])) for r in rows), key=repr)


@pytest.mark.parametrize("p,q", [([1, 2, 3], [1, 2, 3]), ([1, 0, 0], [0, 1, 0]), ([5, 1, 0], [1, 1, 9]), ([0, 0], [1, 1])])
def test_js_distance(spark, p, q):
    from pyspark.sql import functions as F

    got = spark.range(1).select(js_distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, q))).alias("d")).first()[0]
    if not sum(p):
        assert got is None
        return
    a, b = np.array(p) / sum(p), np.array(q) / sum(q)
    m = (a + b) / 2
    kl = lambda x: sum(u * math.log2(u / v) for u, v in zip(x, m) if u > 0)
    assert got == pytest.approx(math.sqrt((kl(a) + kl(b)) / 2), abs=1e-9)


def test_method_rejects_junk_and_keeps_clean(spark):
    clean = "The river runs by the old town and the people of the valley walk along it in the evening. {} They talk about the {} weather."
    rows = [(i, " ".join(clean.format(f"Number {i} is here.", chr(97 + i % 26) * 4) for _ in range(1)) + f" And item{i} with some other words that is it.", "en", "s", 0) for i in range(300)]
    rows += [(1000 + i, "".join(f"w{i}x{k}*** $$$ ### %%% &&& " for k in range(40)), "en", "s", 0) for i in range(5)]
    got = {r["id"]: r for r in rate_documents(docs(spark, rows)).collect()}
    assert all(got[i]["kept"] for i in range(300))
    assert not any(got[1000 + i]["base_failed"] or got[1000 + i]["kept"] for i in range(5))


def test_short_texts_are_not_rejected_by_histograms(spark):
    rows = [(i, "the quick brown fox jumps over the lazy dog again and again " * 5 + str(i), "en", "s", 0) for i in range(3)]
    rows += [(9, "### *** $$$ %%% &&& ||| <<< >>> ### ***!", "en", "s", 0)]
    assert [r["kept"] for r in rate_documents(docs(spark, rows)).filter("id = 9").collect()] == [True]


def test_empty(spark):
    assert rate_documents(docs(spark, [])).collect() == []
