import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from dialogprep.plans.registry import echo_line_generator
from dialogprep.plans import registry as R
from dialogprep.plans.inference import run_inference
from dialogprep.plans.preference import build_preference_set
from dialogprep.plans.training import build_training_set, packed_blocks, training_batches
from dialogprep.schema import PromptConfig
from dialogprep.session import scratch_path

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def _json_array(spark, df):
    rows = [json.loads(r) for r in df.toJSON().collect()]  # test fixture only
    d = tempfile.mkdtemp(prefix="dialogprep-job-")
    p = os.path.join(d, "data.json")
    with open(p, "w", encoding="utf-8") as f:
        json.dump(rows, f, ensure_ascii=False, indent=2)
    return p


def test_training_set_invariants(spark, tok):
    ex = R.examples(spark, SF)
    train = _json_array(spark, ex.filter("example_id % 4 != 0"))
    dev = _json_array(spark, ex.filter("example_id % 4 = 0"))
    from pyspark.sql import Observation

    obs = Observation("train_build")
    out = build_training_set(spark, train, scratch_path(spark, "job_train"), PromptConfig(multitask=True), tok,
                             dev_path=dev, with_train_dev=True, observation=obs)
    m = obs.get
    assert m["n_rows"] == 2 * ex.count() + 2 * ex.filter("example_id % 4 = 0").count()
    assert m["n_null_target"] == 0 and m["n_over_limit"] >= 0
    n = ex.count()
    counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    n_dev = ex.filter("example_id % 4 = 0").count()
    assert counts == {"train": 2 * n, "eval": 2 * n_dev}
    bad = out.filter((F.size("input_ids") != F.size("labels")) | (F.size("labels") != F.size("attention_mask")))
    assert bad.count() == 0
    b = training_batches(out, 2, tok.pad_token_id)
    assert b.filter(F.size("ids") != F.col("pad_to")).count() == 0
    assert b.count() == 2 * n
    p = packed_blocks(out, 512)
    assert p.filter(F.size("input_ids") > 512).count() == 0


def test_preference_set(spark, tok):
    prefs = R._prefs(spark, SF)
    rows = prefs.orderBy("example_id").collect()
    d = tempfile.mkdtemp(prefix="dialogprep-pref-")
    p = os.path.join(d, "prefs.json")
    with open(p, "w", encoding="utf-8") as f:
        json.dump({"prompt": [r["prompt"] for r in rows], "chosen": [r["chosen"] for r in rows],
                   "rejected": [r["rejected"] for r in rows]}, f, ensure_ascii=False)
    out = build_preference_set(spark, p, scratch_path(spark, "job_pref"), tok, cutoff=100000, test_size=0.25,
                               max_length=256, max_prompt_length=128)
    assert out.count() == len(rows)
    assert out.filter(F.col("split") == "test").count() == -(-len(rows) // 4)
    assert out.filter(F.size("prompt_ids") + F.greatest(F.size("chosen_ids"), F.size("rejected_ids")) > 256
                      ).filter(F.size("prompt_ids") > 128).count() == 0


def test_inference_predictions_and_submission(spark, tok):
    ex = R.examples(spark, SF).withColumn("extra", F.lit("kept"))
    path = _json_array(spark, ex)
    marker = [ord(c) + 16 for c in "[Conversation]\n"]
    factory = echo_line_generator(marker, ord("\n") + 16, tok.eos_token_id, 64)
    preds = run_inference(spark, path, scratch_path(spark, "job_pred"), factory, tok)
    assert preds.count() == ex.count() and "predict" in preds.columns and "extra" in preds.columns
    sub = run_inference(spark, path, scratch_path(spark, "job_sub"), factory, tok, do_submit=True)
    assert "predict" not in sub.columns and sub.count() == ex.count()
