"""Jobs on data as the reference reads it: records without ids, several files, bad lines."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialogprep.operators import collate, pack, split_hash
from dialogprep.operators.generate import generate_column
from dialogprep.operators.ordinal import attach, by_range, file_order_index, order_rank
from dialogprep.operators.preferences import shuffle, split_exact
from dialogprep.plans.inference import run_inference
from dialogprep.plans.preference import build_preference_set
from dialogprep.plans.training import build_training_set, packed_blocks, training_batches
from dialogprep.schema import PromptConfig
from dialogprep.session import ensure_checkpoint_dir
from dialogprep.sources import load_examples, materialize, read_examples, read_preference_rejects, read_preferences


def record(i):
    return {"input": {"conversation": [{"speaker": "A", "utterance": f"text {i} " * (1 + i % 5)}], "subject_keyword": ["k"]}, "output": f"out {i}"}


def lines(path, records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records), encoding="utf-8")


def test_train_and_dev_without_ids(spark, tok, tmp_path):
    lines(tmp_path / "train.jsonl", [record(i) for i in range(5)])
    lines(tmp_path / "dev.jsonl", [record(100 + i) for i in range(3)])
    out = build_training_set(spark, str(tmp_path / "train.jsonl"), str(tmp_path / "out"), PromptConfig(), tok,
                             dev_path=str(tmp_path / "dev.jsonl"), with_train_dev=True, multi_line=False)
    rows = out.collect()
    train = [r for r in rows if r["split"] == "train"]
    assert len(train) == 8 and len({(r["origin"], r["example_id"]) for r in train}) == 8
    assert len([r for r in rows if r["split"] == "eval"]) == 3
    batches = training_batches(out, 3, tok.pad_token_id).collect()
    assert len(batches) == 8 and len({r["batch_id"] for r in batches}) == 3
    assert training_batches(out, 2, tok.pad_token_id, split="eval").count() == 3
    order = sorted(train, key=lambda r: (r["origin"], r["example_id"]))
    ids = [i for r in order for i in r["input_ids"]]
    blocks = sorted(packed_blocks(out, 64).collect(), key=lambda r: (r["group"], r["chunk"]))
    assert [i for b in blocks for i in b["input_ids"]] == ids[:len(ids) // 64 * 64]
    assert all(len(b["input_ids"]) == 64 for b in blocks)


def test_keys_follow_source_order_over_files_and_splits(spark, tmp_path, monkeypatch):
    lines(tmp_path / "in" / "a.jsonl", [record(0)])
    lines(tmp_path / "in" / "b.jsonl", [record(i) for i in range(1, 400)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = read_examples(spark, str(tmp_path / "in"))
        got = [r["output"] for r in df.orderBy("example_id").collect()]
        ranked = {r["value"]: r["rank"] for r in file_order_index(spark.read.text(str(tmp_path / "in"))).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [f"out {i}" for i in range(400)]
    assert sorted(ranked.values()) == list(range(400))
    assert ranked[json.dumps(record(7))] == 7


def test_submission_is_one_array_in_source_order(spark, tok, tmp_path):
    lines(tmp_path / "in" / "a.jsonl", [record(0)])
    lines(tmp_path / "in" / "b.jsonl", [record(i) for i in range(1, 200)])

    def factory():
        return lambda prompts: [[*p, 65 + 16] for p in prompts]

    run_inference(spark, str(tmp_path / "in"), str(tmp_path / "sub"), factory, tok, do_submit=True, multi_line=False)
    whole = "\n".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "sub").glob("part-*")))
    array = json.loads(whole)
    assert [r["input"]["conversation"][0]["utterance"] for r in array] == [record(i)["input"]["conversation"][0]["utterance"] for i in range(200)]
    assert all(set(r) == {"input", "output"} and r["output"] == "A" for r in array)
    lines(tmp_path / "none" / "a.jsonl", [])
    schema = spark.read.json(str(tmp_path / "in")).schema
    run_inference(spark, str(tmp_path / "none"), str(tmp_path / "sub0"), factory, tok, do_submit=True, multi_line=False, schema=schema)
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "sub0").glob("part-*")))) == []


def test_bad_records_fail_or_are_routed(spark, tok, tmp_path):
    lines(tmp_path / "in.jsonl", [record(0), '{"input": {"conversation": [', record(2)])
    path = str(tmp_path / "in.jsonl")
    with pytest.raises(ValueError, match="1 malformed"):
        load_examples(spark, path)
    with pytest.raises(ValueError, match="1 malformed"):
        build_training_set(spark, path, str(tmp_path / "out"), PromptConfig(), tok, multi_line=False)
    good, own = load_examples(spark, path, max_rejects=1, reject_path=str(tmp_path / "bad"))
    assert not own
    assert [(r["example_id"][-1], r["output"]) for r in good.orderBy("example_id").collect()] == [("0", "out 0"), ("2", "out 2")]
    assert spark.read.json(str(tmp_path / "bad")).count() == 1


@pytest.mark.parametrize("bad", ['{"prompt": ["p"], "rejected": ["r"]}', '{"prompt": ["p"], "chosen": ["c"', '{"prompt": ["p", "q"], "chosen": ["c"], "rejected": ["r"]}'])
def test_bad_preferences_fail(spark, tmp_path, bad):
    good = json.dumps({"prompt": ["a", "b"], "chosen": ["c", "d"], "rejected": ["e", "f"]})
    lines(tmp_path / "p.jsonl", [good, bad, good])
    with pytest.raises(Exception, match="preference object 1"):
        read_preferences(spark, str(tmp_path / "p.jsonl"), multi_line=False).collect()
    assert [r["obj"] for r in read_preference_rejects(spark, str(tmp_path / "p.jsonl"), multi_line=False).collect()] == [1]
    lines(tmp_path / "g.jsonl", [good, good])
    rows = read_preferences(spark, str(tmp_path / "g.jsonl"), multi_line=False).collect()
    assert sorted((r["obj"], r["pos"], r["prompt"]) for r in rows) == [(0, 0, "a"), (0, 1, "b"), (1, 0, "a"), (1, 1, "b")]


def test_preference_keys_do_not_depend_on_the_place(spark, tok, tmp_path):
    obj = {c: [f"{c}{i}" for i in range(30)] for c in ("prompt", "chosen", "rejected")}
    got = []
    for name in ("here", "elsewhere/deeper"):
        p = tmp_path / name / "x.json"
        p.parent.mkdir(parents=True)
        p.write_text(json.dumps(obj))
        out = build_preference_set(spark, str(p), str(tmp_path / name / "out"), tok, test_size=0.2)
        got.append(sorted((r["pair_id"], r["split"], r["shuffle_rank"]) for r in out.filter("split = 'train'").collect()))
        assert out.filter("split = 'test' AND shuffle_rank IS NOT NULL").count() == 0
    assert got[0] == got[1]
    assert sorted(r[2] for r in got[0]) == list(range(24))


@pytest.mark.parametrize("kind", ["string", "date", "decimal"])
def test_any_key_type(spark, kind):
    df = spark.range(50).select(
        {"string": F.format_string("k%03d", "id"), "date": F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")),
         "decimal": F.col("id").cast("decimal(20,3)")}[kind].alias("k"),
        *[F.array_repeat(F.col("id"), (F.col("id") % 5).cast("int") + 1).alias(c) for c in ("input_ids", "labels", "attention_mask")]).repartition(7)
    flat = [i for i in range(50) for _ in range(i % 5 + 1)]
    blocks = sorted(pack(df, 8, key="k", group_rows=50).collect(), key=lambda r: r["chunk"])
    assert [x for b in blocks for x in b["input_ids"]] == flat[:len(flat) // 8 * 8]
    rows = collate(df, 4, 0, key="k", order="key").collect()
    assert {(r["ids"][0], r["batch_id"]) for r in rows} == {(i, i // 4) for i in range(50)}
    assert [r["rank"] for r in order_rank(df.select("k"), "k").orderBy("k").collect()] == list(range(50))


def test_many_ranges(spark):
    df = spark.range(1000).select(F.reverse(F.format_string("%04d", "id")).alias("k"))
    ranged = by_range(df, ["k"], rows_per_range=50)
    assert ranged.select("_range").distinct().count() > 5
    spans = ranged.groupBy("_range").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("_range").collect()
    assert all(a["hi"] < b["lo"] for a, b in zip(spans, spans[1:]))


def test_null_and_repeated_keys_fail(spark):
    cols = "k string, input_ids array<int>, labels array<int>, attention_mask array<int>"
    for keys, why in ((["a", None], "null in the row key"), (["a", "b", "b"], "repeated row key")):
        df = spark.createDataFrame([(k, [1], [1], [1]) for k in keys], cols)
        for run in (lambda d: collate(d, 2, 0, key="k"), lambda d: collate(d, 2, 0, key="k", order="key"),
                    lambda d: pack(d, 4, key="k"), lambda d: split_exact(d, "k", 0.5), lambda d: attach(d, d.select("k", F.lit(1).alias("x")), ["k"])):
            with pytest.raises(Exception, match=why):
                run(df).collect()


def test_unequal_columns_fail_in_pack(spark):
    df = spark.createDataFrame([("a", [1, 2], [1], [1, 1])], "k string, input_ids array<int>, labels array<int>, attention_mask array<int>")
    with pytest.raises(Exception, match="differ in length"):
        pack(df, 4, key="k").collect()


def test_split_and_shuffle_are_independent(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    both = shuffle(split_hash(df, "k", 0.1), "k")
    ranks = [r["shuffle_rank"] for r in both.filter("split = 'test'").collect()]
    assert 60 < len(ranks) < 140 and 400 < np.mean(ranks) < 600


def test_cache_follows_its_input(spark, tmp_path):
    p = str(tmp_path / "in")
    spark.range(3).write.parquet(p)
    read = lambda: materialize(spark.read.parquet(p), "t", spark, config=str(tmp_path), reuse=True)
    assert read().count() == 3 and read().inputFiles()[0] == read().inputFiles()[0]
    spark.range(4).write.mode("append").parquet(p)
    assert read().count() == 7


def test_generator_gets_batches_and_yields_each(spark):
    seen = spark.sparkContext.accumulator(0)
    most = spark.sparkContext.accumulator(0)

    def factory():
        def gen(prompts):
            seen.add(1)
            most.add(max(0, len(prompts) - 4))
            return [[*p, 9] for p in prompts]
        return gen

    df = spark.range(10).coalesce(1).select(F.array(F.col("id").cast("int")).alias("source_ids"))
    rows = generate_column(df, factory, batch_size=4).collect()
    assert [list(r["out_ids"]) for r in rows] == [[i, 9] for i in range(10)]
    assert (seen.value, most.value) == (3, 0)


def test_no_local_scratch_off_local_masters():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
