"""The result cache is keyed by the computation and published whole; the document is one ordered file or none."""

import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from dialogprep.session import ensure_checkpoint_dir, scratch_path
from dialogprep.sources import materialize, write_document
from dialogprep.sources.writers import computation


@pytest.fixture
def table(spark, tmp_path):
    spark.range(10).select("id", (F.col("id") * 2).alias("x")).write.parquet(str(tmp_path / "t"))
    return str(tmp_path / "t")


def reuse(df, config="v1"):
    return materialize(df, "cache_test", config=config, reuse=True)


def test_other_filters_are_other_results(spark, table):
    d = spark.read.parquet(table)
    assert reuse(d.filter("id > 1")).count() == 8
    assert reuse(d.filter("id > 5")).count() == 4
    assert reuse(d.filter("id > 1")).count() == 8


def test_same_computation_is_found(spark, table):
    a = reuse(spark.read.parquet(table).filter("id > 2").withColumn("y", F.col("x") + 1))
    b = reuse(spark.read.parquet(table).where(F.col("id") > 2).withColumn("y", F.col("x") + 1))
    assert a.inputFiles() == b.inputFiles() and b.count() == 7
    for other in (spark.read.parquet(table).filter("id > 2").withColumn("z", F.col("x") + 1), spark.read.parquet(table).filter("id > 2").withColumn("y", F.col("x") + 2)):
        got = reuse(other)
        assert got.inputFiles() != a.inputFiles() and got.columns == other.columns
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, other.collect()))
    assert reuse(spark.read.parquet(table).filter("id > 2"), config="v2").inputFiles() != reuse(spark.read.parquet(table).filter("id > 2")).inputFiles()


def test_many_columns_count(spark, tmp_path):
    """Plans are compared with all their fields, not the first 25."""
    d = spark.range(3).select(*[(F.col("id") + i).alias(f"c{i}") for i in range(60)])
    d.write.parquet(str(tmp_path / "w"))
    d = spark.read.parquet(str(tmp_path / "w"))
    assert computation(d.withColumn("c59", F.lit(1))) != computation(d.withColumn("c59", F.lit(2)))


def test_sides_and_subqueries_count(spark, table, tmp_path):
    spark.range(5).select("id", (F.col("id") * 2).alias("x")).write.parquet(str(tmp_path / "u"))
    t, u = spark.read.parquet(table), spark.read.parquet(str(tmp_path / "u"))
    assert reuse(t.exceptAll(u)).count() == 5 and reuse(u.exceptAll(t)).count() == 0
    t.createOrReplaceTempView("cache_t")
    u.createOrReplaceTempView("cache_u")
    q = "SELECT id FROM cache_t WHERE id > (SELECT max(id) FROM cache_%s)"
    assert reuse(spark.sql(q % "u")).count() == 5 and reuse(spark.sql(q % "t")).count() == 0


def test_changed_input_and_lost_files(spark, table):
    first = reuse(spark.read.parquet(table).filter("id > 3"))
    spark.range(10, 12).select("id", (F.col("id") * 2).alias("x")).write.mode("append").parquet(table)
    assert reuse(spark.read.parquet(table).filter("id > 3")).count() == 8
    kept = reuse(spark.read.parquet(table).filter("id > 4"))
    os.unlink(kept.inputFiles()[0].removeprefix("file://"))
    assert reuse(spark.read.parquet(table).filter("id > 4")).count() == 7
    assert first.count() == 6


def test_what_has_no_identity_is_refused(spark, table):
    with pytest.raises(ValueError, match="no identity"):
        reuse(spark.createDataFrame([(1,)], "a int"))
    twice = F.udf(lambda x: x * 2, "long")
    with pytest.raises(ValueError, match="version"):
        reuse(spark.read.parquet(table).select(twice("id")), config=None)
    assert reuse(spark.read.parquet(table).select(twice("id").alias("y")), config="twice-1").count() == 10


def test_concurrent_writers_agree(spark, table):
    """Two sessions at once: all get one whole table, and the losers' folders are gone."""
    got, errors = [], []

    def one():
        try:
            s = spark.newSession()
            s.conf.set("spark.sql.shuffle.partitions", "8")
            got.append(materialize(s.read.parquet(table).filter("id > 7 OR x < 4"), "race", s, reuse=True))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=one) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    assert len({tuple(g.inputFiles()) for g in got}) == 1 and {g.count() for g in got} == {4}
    root = ensure_checkpoint_dir(spark).removeprefix("file:")
    assert len([n for n in os.listdir(f"{root}/dialogprep-cache") if n.startswith("race-") and not n.endswith((".manifest", ".crc"))]) == 1


def test_failed_write_publishes_nothing(spark, table):
    bad = spark.read.parquet(table).select(F.when(F.col("id") == 9, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="no"):
        reuse(bad)
    with pytest.raises(Exception, match="no"):
        reuse(bad)


RECORDS = [{"pos": i, "input": {"a": [1.5, None, "é \U0001F600 \"q\" \\ \n"], "e": []}, "output": None if i % 3 else "x\ny"} for i in range(25)]
DDL = "pos long, input struct<a array<string>, e array<string>>, output string"


def test_document_is_what_json_dump_writes(spark, tmp_path):
    want = [{"pos": i, "input": {"a": ["é \U0001F600 \"q\" \\ \n", None], "e": []}, "output": None if i % 3 else "x\ny"} for i in range(25)]
    df = spark.createDataFrame(want, DDL).repartition(5)
    path = str(tmp_path / "out" / "doc.json")
    os.makedirs(os.path.dirname(path))
    write_document(df, path)
    text = open(path, encoding="utf-8").read()
    assert text == json.dumps(want, indent=2, ensure_ascii=False) + "\n"
    write_document(df.filter("pos < 1"), path, indent=4, drop=("pos",))  # replaces it
    assert json.load(open(path)) == [{k: want[0][k] for k in ("input", "output")}]
    write_document(df.filter("pos < 0"), path)
    assert json.load(open(path)) == []
    assert [n for n in os.listdir(os.path.dirname(path)) if not n.endswith(".crc")] == ["doc.json"]


def test_failed_document_leaves_the_old_one(spark, tmp_path):
    path = str(tmp_path / "doc.json")
    df = spark.range(20).withColumnRenamed("id", "pos")
    write_document(df, path)
    before = open(path).read()
    src = scratch_path(spark, "doc_src")
    df.write.parquet(src)
    broken = spark.read.parquet(src).withColumn("x", F.when(F.col("pos") == 13, F.raise_error(F.lit("lost"))).otherwise(1))
    with pytest.raises(Exception, match="lost"):
        write_document(broken, path, materialized=True)
    assert open(path).read() == before
    assert not [n for n in os.listdir(tmp_path) if "stage" in n]
