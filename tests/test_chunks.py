"""Conversations of any length as chunks: nothing is lost, no chunk is over its bound, texts and ids join to the whole."""

import random

import pytest
from pyspark.sql import functions as F

from dialogprep.functions import prompts as P
from dialogprep.operators import assemble, assemble_chunks, assemble_conversations, chunk_rows, chunk_text, pack

SCHEMA = "conv_id long, turn long, role string, text string"


def turns(seed, hot=400, convs=12):
    rnd = random.Random(seed)
    rows = [(c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["", None, "hello", "é中\U0001F600", "w " * 30, f"n{t}"])) for c in range(convs) for t in range(rnd.randint(1, 6))]
    rows += [(99, t, "user", f"turn {t}") for t in range(hot)] + [(None, 0, "user", "no id"), (None, 1, "user", "no id")]
    rows += [(50, None, "user", "same")] * 30 + [(51, 0, "user", "x" * 5000), (51, 1, "user", "after")]
    rnd.shuffle(rows)
    return rows


def expected(rows, most):
    out = {}
    for k in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0))
        run = 0
        for _, t, role, text in mine:
            out.setdefault((k, run // most), []).append((t, role, text))
            run += len((role or "").encode()) + len((text or "").encode())
    return out


@pytest.mark.parametrize("range_bytes", [300, 1 << 28])
@pytest.mark.parametrize("most", [64, 1000, 1 << 22])
def test_equals_running_bytes(spark, monkeypatch, range_bytes, most):
    monkeypatch.setattr(assemble, "RANGE_BYTES", range_bytes)
    rows = turns(most)
    got = {(r.conv_id, r.chunk): [tuple(t) for t in r.turns] for r in assemble_chunks(spark.createDataFrame(rows, SCHEMA), max_bytes=most).collect()}
    assert got == expected(rows, most)


def test_texts_and_ids_join_to_the_whole(spark, monkeypatch, tok):
    monkeypatch.setattr(assemble, "RANGE_BYTES", 500)
    df = spark.createDataFrame([r for r in turns(5) if r[0] not in (None, 50)], SCHEMA)
    chunks = assemble_chunks(df, max_bytes=100)
    parts = chunks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("chunk", chunk_text(F.col("turns"), F.col("chunk")).alias("x")))).alias("p"))
    joined = {r.conv_id: "".join(p.x for p in r.p) for r in parts.collect()}
    whole = assemble_conversations(df).withColumn("c", F.transform("turns", lambda t: F.struct(t["role"].alias("speaker"), t["text"].alias("utterance"))))
    want = {r.conv_id: r.x for r in whole.select("conv_id", P.transcript(F.col("c")).alias("x")).collect()}
    assert joined == want
    ids = {r.conv_id: r.ids for r in whole.select("conv_id", tok.encode(P.transcript(F.col("c")), add_special=True).alias("ids")).collect()}
    rows = chunk_rows(chunks, tok)
    assert rows.filter("size(labels) <> size(input_ids) OR size(attention_mask) <> size(input_ids)").isEmpty()
    packed = pack(rows, 64, key=["conv_id", "chunk"], group_rows=100_000)
    stream = [x for r in sorted(packed.collect(), key=lambda r: (r.group, r.chunk)) for x in r.input_ids]
    flat = [x for k in sorted(ids) for x in ids[k]]
    assert stream == flat[:len(flat) // 64 * 64]


def test_empty_and_other_names(spark):
    assert assemble_chunks(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([("a", 2, "z", "k"), ("a", 1, "y", "r")], "who string, at int, say string, k string")
    assert [(r.who, r.chunk, [tuple(t) for t in r.turns]) for r in assemble_chunks(df, "who", "at", ("say",)).collect()] == [("a", 0, [(1, "y"), (2, "z")])]
