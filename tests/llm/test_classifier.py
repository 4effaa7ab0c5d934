import math
import unicodedata
import zlib

import pytest
from pyspark.sql import functions as F

from dialogprep.llm.classifier import STATISTICS, RuleModel, accept, classify, fit, with_statistics
from dialogprep.llm.common import text_of
from tests.llm.helpers import HARD, clashing, docs, words

SF = "/root/testdata/sf0.01"


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    pytest.importorskip("os").path.isdir(SF) or pytest.skip("no data")
    d, y = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = fit(d, y)
    assert 0 < len(model.rules) < 60 and model.describe()
    scored = classify(d, model)
    rows = scored.join(y, scored["id"] == y["doc_id"]).filter("held_out").collect()
    assert len(rows) > 50
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95
    assert all((r["score"] >= 0.7) == (r["predicted"] == 1) for r in rows)


def test_labels_of_held_out_rows_do_not_matter(spark):
    good = "the cat sat on the mat and looked at the long river. " * 4
    bad = "$$$ ### *** %%% &&& " * 20
    rows = [(i, bad + str(i) if i % 3 == 0 else good + str(i), "en", "s", 0) for i in range(400)]
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    true = [(i, 0 if i % 3 == 0 else 1, 0) for i in range(400)]
    flipped = [(i, 1 - q if i in set(held) else q, 0) for i, q, _ in true]
    a, b = (fit(docs(spark, rows), labels(spark, y)) for y in (true, flipped))
    assert a == b
    got = {r["id"]: r["predicted"] for r in classify(docs(spark, rows), a).collect()}
    assert all(got[i] == q for i, q, _ in true)
    kept = accept(clashing(docs(spark, rows)), a)
    assert kept.columns == clashing(docs(spark, rows)).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, q, _ in true if q]


def plain_statistics(text):
    """The statistics, restated over one text."""
    t = text or ""
    w, lines, n = words(t), [x for x in t.split("\n") if words(x)], max(len(t), 1)
    n_words, n_lines = max(len(w), 1), max(len(lines), 1)
    some = lambda chars: sum(t.count(c) for c in chars) / n
    return {
        "log_words": math.log1p(len(w)), "mean_word": n / n_words, "upper": sum(unicodedata.category(c) == "Lu" for c in t) / n,
        "symbols": some("#*$%&|<>"), "bangs": some("!"), "digits": some("0123456789"), "stops": some(".,;:?"),
        "distinct": len(set(w)) / n_words, "dup_lines": (len(lines) - len(set(lines))) / n_lines, "line_words": len(w) / n_lines,
        "non_ascii": (len(t.encode()) - len(t)) / n,
    }


def plain_score(model, text):
    if model.constant is not None:
        return model.constant
    stats, z = plain_statistics(text), model.intercept
    for bounds, weight in model.rules:
        if all(stats[STATISTICS[i]] <= v if op == "<=" else stats[STATISTICS[i]] > v for i, op, v in bounds):
            z += weight
    return 1 / (1 + math.exp(-z))


ODD = ["A\n\nA\nB \n\x0bC!?", "ÀÉ ß Ω 5\u0664 #*$%&|<>", "\r\n x \u2003 \n x", "one\u00a0word", "\U0001D400 \U0001F600!", "Same line. \nSame line. \nSame line."]


def test_statistics_equal_brute_force(spark):
    rows = HARD + [(200 + i, t, "en", "s", 0) for i, t in enumerate(ODD)]
    got = with_statistics(docs(spark, rows).select(F.col("text").alias("raw"), text_of(F.col("text")).alias("text"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["stats"].asDict() == pytest.approx(plain_statistics(r["raw"])), (r["raw"] or "")[:60]


def test_scores_equal_brute_force(spark):
    """Every document's score by the fitted rules, evaluated one by one in plain Python."""
    pytest.importorskip("os").path.isdir(SF) or pytest.skip("no data")
    d, y = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = fit(d, y)
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    got = classify(d, model).collect()
    assert len(got) == len(texts) and len(model.rules) > 0
    for r in got:
        assert r["score"] == pytest.approx(plain_score(model, texts[r["id"]]))
        assert r["held_out"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2)


def test_repeated_documents_and_labels(spark):
    """Rows that repeat an id train once each, and get the same score."""
    good, bad = "the cat sat on the mat and looked at the long river. " * 4, "$$$ ### *** %%% &&& " * 20
    rows = [(i, (bad if i % 3 == 0 else good) + str(i), "en", "s", 0) for i in range(200) for _ in range(1 + i % 4)]
    y = [(i, int(i % 3 != 0), 0) for i in range(200) for _ in range(1 + i % 2)]
    model = fit(docs(spark, rows), labels(spark, y))
    got = classify(docs(spark, rows), model).collect()
    assert len(got) == len(rows)
    assert all(r["predicted"] == int(r["id"] % 3 != 0) for r in got)
    assert all(r["score"] == pytest.approx(plain_score(model, rows_text)) for r, rows_text in [(r, next(x[1] for x in rows if x[0] == r["id"])) for r in got])


def test_hard_rows_get_scores(spark):
    model = RuleModel(-1.0, (((((0, ">", 1.0),)), 2.0),))
    got = clashing(docs(spark)).transform(classify, model).collect()
    assert len(got) == len(HARD) and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in got)


@pytest.mark.parametrize("rows,score", [([], 1.0), ([(1, 1, 0)], 1.0), ([(1, 0, 0), (9, 0, 0)], 0.0), ([(1, None, 0), (None, 0, 0), (77, 0, 0)], 1.0)])
def test_too_few_labels(spark, rows, score):
    model = fit(docs(spark), labels(spark, rows))
    assert {r["score"] for r in classify(docs(spark), model).collect()} == {score}


def test_empty(spark):
    model = fit(docs(spark, []), labels(spark, [(1, 1, 0)]))
    assert classify(docs(spark, []), model).collect() == []
