from pyspark.sql import functions as F

from dialogprep.operators import build_prompts, concat_splits, dataset_stats, encode_examples, preview
from dialogprep.schema import PromptConfig
from tests.conftest import make_examples


def _rows(spark, tok, cfg, recs):
    return {(r["example_id"], r["task"]): r
            for r in encode_examples(build_prompts(make_examples(spark, recs), cfg, None, tok), tok).collect()}


def test_sft_labels_and_eos(spark, tok):
    rows = _rows(spark, tok, PromptConfig(), [(1, [("A", "hi")], ["k"], "ans"), (2, [("A", "x")], [], ""),
                                              (3, [("A", "y")], [], None)])
    r = rows[(1, "summary")]
    src = [1] + [ord(c) + 16 for c in r["source_text"]]
    tgt = [ord(c) + 16 for c in "ans"] + [2]
    assert r["input_ids"] == src + tgt
    assert r["labels"] == [-100] * len(src) + tgt
    assert r["attention_mask"] == [1] * len(src + tgt)
    for k in (2, 3):  # empty and null target: no EOS, nothing to learn
        e = rows[(k, "summary")]
        assert e["target_ids"] == [] and set(e["labels"]) == {-100}


def test_tapt_labels_copy_ids(spark, tok):
    rows = _rows(spark, tok, PromptConfig(do_tapt=True), [(1, [("A", "hi")], ["k"], "ans")])
    r = rows[(1, "summary")]
    assert r["labels"] == r["input_ids"] and r["target_ids"] == []
    assert not r["source_text"].endswith("<|assistant|>\n")


def test_multitask_adds_topic_row(spark, tok):
    rows = _rows(spark, tok, PromptConfig(multitask=True), [(1, [("A", "hi")], ["k1", "k2"], "ans")])
    assert set(rows) == {(1, "summary"), (1, "topic")}
    assert rows[(1, "topic")]["target_text"] == "k1, k2"
    assert rows[(1, "topic")]["task_order"] == 1


def test_instruction_mode_bypasses_template(spark, tok):
    rows = _rows(spark, tok, PromptConfig(use_custom_prompt=True), [(1, [("A", "hi")], ["k"], "ans")])
    r = rows[(1, "summary")]
    assert r["source_text"].startswith("### Instruction") and "<|system|>" not in r["source_text"]
    assert r["messages"][0]["role"] == "user" and r["messages"][0]["content"] == r["source_text"]


def test_mode_precedence():
    assert PromptConfig(do_tapt=True, use_custom_prompt=True, one_shot=True).mode == "tapt"
    assert PromptConfig(use_custom_prompt=True, one_shot=True).mode == "instruction"
    assert PromptConfig(one_shot=True, dynamic_fewshot=True).mode == "one_shot"


def test_concat_splits_and_stats(spark):
    a = spark.createDataFrame([(1, [1, 2]), (2, [1] * 5)], "example_id long, input_ids array<int>")
    b = spark.createDataFrame([(3, [1, 2, 3])], "example_id long, input_ids array<int>")
    u = concat_splits(a, b)
    assert sorted((r["example_id"], r["split"]) for r in u.collect()) == [(1, "train"), (2, "train"),
                                                                           (3, "eval"), (3, "train")]
    s = {r["split"]: r for r in dataset_stats(u, limit=2).collect()}
    assert (s["train"]["n_rows"], s["train"]["n_tokens"], s["train"]["max_tokens"], s["train"]["n_over_limit"]) == (3, 10, 5, 2)


def test_preview_unmasks_with_pad(spark, tok):
    e = encode_examples(build_prompts(make_examples(spark, [(1, [], [], "ok")]), PromptConfig(), None, tok), tok)
    r = preview(e, tok).collect()[0]
    assert r["label_text"].startswith("<eos>") and r["label_text"].endswith("ok<eos>")
    assert r["input_text"].startswith("<bos><|system|>")
