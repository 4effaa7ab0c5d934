"""JSON arrays cut at arbitrary bytes equal Spark's one-task reader."""

import json
import random

import pytest
from pyspark.sql import functions as F

from dialogprep.sources import json_array
from dialogprep.sources.json_array import CORRUPT, cut, lexed, read_json_array

TEXTS = ["plain", 'a "quoted" } brace', "back\\slash", 'ends in \\', '\\"', '"', "}{][,", "[1, {2}]", "é 中 \U0001F600", "", "line\nbreak\ttab", "\\\\" * 5 + '"', "x" * 300, "},{" * 40]


def records(seed, n):
    rnd = random.Random(seed)
    return [{"id": i, "input": {"conversation": [{"speaker": rnd.choice(TEXTS), "utterance": rnd.choice(TEXTS)} for _ in range(rnd.randint(0, 4))],
                                "subject_keyword": [rnd.choice(TEXTS) for _ in range(rnd.randint(0, 2))]}, "output": rnd.choice([*TEXTS, None])} for i in range(n)]


@pytest.fixture
def splits(spark):
    """Splits of a few bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def use(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield use
    for k, v in old.items():
        spark.conf.set(k, v)


def rows(df):
    return sorted((json.dumps(r.asDict(recursive=True), sort_keys=True) for r in df.collect()))


def in_order(df):
    return [json.dumps(r.asDict(recursive=True), sort_keys=True) for r in df.orderBy("_file", "_pos").drop("_file", "_pos").collect()]


@pytest.mark.parametrize("indent,split,size", [(None, 900, 40), (2, 700, 1 << 20), (None, 1 << 20, 1)])
def test_equals_one_task(spark, splits, tmp_path, indent, split, size):
    for name, seed, n in (("a.json", 1, 15), ("b.json", 2, 4), ("c d.json", 3, 0), ("e.json", 4, 1)):
        (tmp_path / name).write_text(json.dumps(records(seed, n), indent=indent, ensure_ascii=bool(seed % 2)), encoding="utf-8")
    want = spark.read.option("multiLine", True).json(str(tmp_path))
    splits(split)
    got = read_json_array(spark, str(tmp_path), size=size)
    assert got.drop("_file", "_pos").schema == want.schema
    assert rows(got.drop("_file", "_pos")) == rows(want)
    source = [json.dumps(r, sort_keys=True) for seed, n in ((1, 15), (2, 4), (3, 0), (4, 1)) for r in records(seed, n)]
    assert in_order(got) == source
    assert got.groupBy("_file").agg(F.max("_pos").alias("p"), F.count("*").alias("n")).filter("p + 1 <> n").isEmpty()


def test_more_than_one_task(spark, splits, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(records(5, 100)))
    splits(2000)
    assert json_array.chunks(spark, str(tmp_path)).rdd.getNumPartitions() > 4


def test_element_over_many_ranges(spark, splits, tmp_path):
    """One element larger than several splits, full of braces."""
    data = [{"id": 0, "t": "}" * 5000 + '"' * 50 + "\\" * 51}, {"id": 1, "t": "{[" * 900}]
    (tmp_path / "a.json").write_text(json.dumps(data))
    splits(900)
    assert in_order(read_json_array(spark, str(tmp_path), size=100)) == [json.dumps(r, sort_keys=True) for r in data]


def test_malformed_elements_are_single_rejects(spark, splits, tmp_path):
    text = '[{"id": 1}, {"id": bad}, {"id": 3}, , {"id": 5}, {"id": {"x": 6}'
    (tmp_path / "a.json").write_text(text)
    (tmp_path / "b.json").write_text('[{"id": 7}\n')  # never closed
    splits(16)
    got = read_json_array(spark, str(tmp_path), schema=spark.createDataFrame([], f"id long, {CORRUPT} string").schema, size=8)
    r = got.orderBy("_file", "_pos").collect()
    assert [(x.id, x[CORRUPT] is None) for x in r] == [(1, True), (None, False), (3, True), (None, False), (5, True), (None, False), (None, False)]
    assert r[1][CORRUPT] == '{"id": bad}'
    assert CORRUPT in read_json_array(spark, str(tmp_path)).columns


def test_other_files_and_schema(spark, splits, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1,\n "t": "a, [b]"}')
    (tmp_path / "b.json").write_text(' \n[{"id": 2, "t": null, "more": 1}] trailing [{"id": 3}]')
    (tmp_path / "c.json").write_text("")
    schema = spark.createDataFrame([], "id long, t string").schema
    splits(12)
    got = read_json_array(spark, str(tmp_path), schema=schema, size=6)
    assert [(r["_file"], r["_pos"], r.id, r.t) for r in got.orderBy("_file").collect()] == [(0, 0, 1, "a, [b]"), (1, 0, 2, None)]


def test_scan_is_a_monoid():
    """The state behind a text follows from its parts' changes, wherever it is cut at a brace."""
    text = json.dumps(records(9, 30)).encode()
    ends = [i + 1 for i, c in enumerate(text) if c == ord("}")] + [len(text)]
    rnd = random.Random(1)
    for _ in range(20):
        cuts = [0, *sorted(rnd.sample(ends[:-1], 5)), len(text)]
        inside, depth, whole = 0, 0, []
        for n, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
            part = text[x:y]
            whole += [(x + a, x + b, s, e) for a, b, s, e in cut(part, inside, depth, n == 0)]
            a, parity, change = lexed(part)
            out = ~(parity ^ bool(inside))
            depth += int(change[out].sum())
            inside ^= int(parity[-1])
        assert [w[0] for w in whole if w[2]] == [w[0] for w in cut(text, 0, 0, True)]
