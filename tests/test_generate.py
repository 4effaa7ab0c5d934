from pyspark.sql import functions as F

from dialogprep.functions import continuation
from dialogprep.operators import decode_prediction, generate_column, join_predictions, map_batches


def test_continuation_short_output(spark):
    r = spark.range(1).select(continuation(F.array(F.lit(1), F.lit(2)), F.array(*[F.lit(i) for i in range(5)])).alias("c")).collect()[0]
    assert r["c"] == []


def test_generate_column_passthrough_and_decode(spark, tok):
    df = spark.createDataFrame([(1, [1, 16 + ord("a")], "keep"), (2, [1], "x")],
                               "example_id long, source_ids array<int>, other string")

    def factory():
        return lambda prompts: [p + [16 + ord("z"), 2] for p in prompts]

    g = decode_prediction(generate_column(df, factory, batch_size=1), tok)
    rows = {r["example_id"]: r for r in g.collect()}
    assert rows[1]["predict"] == "z" and rows[1]["other"] == "keep"


def test_left_join_keeps_records_without_prediction(spark):
    rec = spark.createDataFrame([(1, "a"), (2, "b")], "example_id long, output string")
    pred = spark.createDataFrame([(1, "p")], "example_id long, predict string")
    rows = {r["example_id"]: r["predict"] for r in join_predictions(rec, pred).collect()}
    assert rows == {1: "p", 2: None}


def test_map_batches_changes_row_count(spark):
    df = spark.range(10)
    out = map_batches(df, lambda pdf: pdf[pdf["id"] % 2 == 0], "id long")
    assert sorted(r["id"] for r in out.collect()) == [0, 2, 4, 6, 8]
