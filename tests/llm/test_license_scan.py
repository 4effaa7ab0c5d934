import pytest

from dialogprep.llm.license_scan import PHRASES, TEMPLATES, compile_template, scan, tokens_of
from tests.llm.helpers import HARD, clashing, docs

LICENSES = [
    ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
    ("licensed under GNU General Public License version 3", "gpl"),
    ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"),
    ("LICENSED UNDER A CC BY 4.0", "cc-by,cc-by-4.0"),
    ("Licensed under the Apache License, Version 1.0.", ""),
    ("Licensed under the Big Apache License, Version 2.0.", ""),
    ("Copyright (c) 2020 Some Person All Rights Reserved", "proprietary,reserved"),
    ("The MIT License", "mit"),
    ("limit license", ""),
    ("cc by cc by x cc by", "cc-by"),
]


def brute(text):
    w = tokens_of(text or "")
    at, labels = [], set()
    for phrase, label in PHRASES:
        p = tokens_of(phrase)
        here = [i for i in range(len(w)) if w[i:i + len(p)] == p]
        at += here
        labels |= {label} if here else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), sorted(labels)


def test_base_equals_brute_force(spark):
    rows = HARD + [(100 + i, t, "en", "s", 0) for i, (t, _) in enumerate(LICENSES)]
    got = clashing(docs(spark, rows)).transform(scan).select("id", "n_words", "n_base", "first_word", "last_word", "base_labels", "score").collect()
    assert sorted(((r[0], *r[1:5], list(r[5])) for r in got), key=repr) == sorted(((r[0], *brute(r[1])) for r in rows), key=repr)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_templates(spark):
    rows = [(i, f"Some text before.\n{t}\nand after.", "en", "s", 0) for i, (t, _) in enumerate(LICENSES)]
    got = {r["id"]: r for r in scan(docs(spark, rows)).collect()}
    for i, (t, labels) in enumerate(LICENSES):
        assert ",".join(got[i]["labels"]) == labels, t
    assert got[0]["score"] == pytest.approx(8 / 13)
    assert scan(docs(spark, [(1, LICENSES[0][0], "en", "s", 0)])).first()["score"] == 1.0


def test_markup():
    import re

    a = re.compile(compile_template("Use [[only]] the {{name:2}} license [[of [[that]] sort]]"))
    yes = ["use the big license ", "use only the very big license of sort ", "use the x license of that sort "]
    no = ["use the license ", "use not the big license ", "use the a b c license "]
    assert all(a.fullmatch(t) for t in yes) and not any(a.fullmatch(t) for t in no)
    for bad in ("a [[b", "a ]] b"):
        with pytest.raises(ValueError):
            compile_template(bad)
    for ts in TEMPLATES.values():
        for t in ts:
            re.compile(compile_template(t))


def test_other_phrases_overlap_and_empty(spark):
    df = docs(spark, [(1, "a b a b a", "en", "s", 0)])
    r = scan(df, phrases=(("a b a", "x"), ("b a b", "y")), templates={}).first()
    assert (r["n_base"], r["first_word"], r["last_word"], list(r["labels"]), r["score"]) == (3, 0, 2, ["x", "y"], 0.0)
    assert scan(docs(spark, [])).collect() == []
