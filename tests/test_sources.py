import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from dialogprep.schema import EXAMPLE_SCHEMA
from dialogprep.session import scratch_path
from dialogprep.sources import read_examples, read_few_shot_pool, read_preferences, split_corrupt, write_predictions


def _tmpfile(name, content):
    d = tempfile.mkdtemp(prefix="dialogprep-src-")
    p = os.path.join(d, name)
    with open(p, "w", encoding="utf-8") as f:
        f.write(content)
    return p


def test_json_array_document_with_extra_and_null_fields(spark):
    recs = [
        {"input": {"conversation": [{"speaker": "A", "utterance": "안녕\n\"hi\""}], "subject_keyword": ["k"]},
         "output": "o", "extra": 1, "note": None},
        {"input": {"conversation": [], "subject_keyword": []}, "output": "", "extra": 2, "note": "x"},
    ]
    p = _tmpfile("corpus.json", json.dumps(recs, ensure_ascii=False, indent=2))
    df = read_examples(spark, p, multi_line=True)
    rows = sorted(df.collect(), key=lambda r: r["extra"])
    assert [r["input"]["conversation"][0]["utterance"] for r in rows[:1]] == ['안녕\n"hi"']
    assert rows[0]["extra"] == 1 and rows[1]["note"] == "x"
    assert rows[0]["example_id"] < rows[1]["example_id"]  # file order kept
    out = scratch_path(spark, "test_pred")
    write_predictions(df.withColumn("predict", F.lit("p")), out)
    back = [json.loads(r["value"]) for r in spark.read.text(out).collect()]
    assert any("note" in b and b["note"] is None for b in back)  # null field written
    assert any("안녕" in json.dumps(b, ensure_ascii=False) for b in back)


def test_corrupt_rows_are_routed(spark):
    p = _tmpfile("c.jsonl", '{"output": "a"}\n{broken\n')
    good, bad = split_corrupt(read_examples(spark, p, schema=EXAMPLE_SCHEMA))
    assert len(good.collect()) == 1 and len(bad.collect()) == 1


def test_pool_csv_with_newlines_and_quotes(spark):
    p = _tmpfile("few_shot.csv", 'text\n"first\nline"\n"say ""hi"""\nplain\n')
    rows = [(r["pos"], r["text"]) for r in read_few_shot_pool(spark, p).orderBy("pos").collect()]
    assert rows == [(0, "first\nline"), (1, 'say "hi"'), (2, "plain")]


def test_preferences_columnar(spark):
    p = _tmpfile("prefs.json", json.dumps({"prompt": ["p1", "p2"], "chosen": ["c1", "c2"], "rejected": ["r1", "r2"]}))
    rows = [(r["pos"], r["prompt"], r["chosen"], r["rejected"]) for r in read_preferences(spark, p).orderBy("pos").collect()]
    assert rows == [(0, "p1", "c1", "r1"), (1, "p2", "c2", "r2")]


def test_preferences_unequal_arrays_fail(spark):
    p = _tmpfile("bad.json", json.dumps({"prompt": ["p1", "p2"], "chosen": ["c1"], "rejected": ["r1", "r2"]}))
    with pytest.raises(Exception):
        read_preferences(spark, p).collect()


def test_submission_as_one_json_array(spark):
    from dialogprep.sources import write_submission

    df = spark.createDataFrame([(i, f"out {i}", None if i % 3 else "x") for i in range(50)],
                               "pos long, output string, note string").repartition(5)
    out = scratch_path(spark, "test_sub")
    write_submission(df, out, order_col="pos", as_json_array=True)
    files = sorted(r["f"] for r in spark.read.text(out).select(F.input_file_name().alias("f")).distinct().collect())
    text = "".join(r["value"] + "\n" for f in files
                   for r in spark.read.text(f).collect())  # test: concatenate the parts in name order
    recs = json.loads(text)
    assert [r["pos"] for r in recs] == list(range(50))
    assert recs[1]["note"] is None and recs[0]["note"] == "x"
