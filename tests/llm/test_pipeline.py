import zlib
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from dialogprep.llm import near_dedup
from dialogprep.llm.bpe import load_ranks
from dialogprep.session import ARROW_BYTES
from tests.llm.helpers import AZ, clashing, docs
from tests.llm.test_near_dedup import crowded, shingle_set


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Clean and junk texts, exact and near copies, a null text and more columns."""
    path = tmp_path_factory.mktemp("sf")
    names = ["river", "house", "garden", "winter", "letter", "window", "stone", "paper", "summer", "morning", "bridge", "corner"]
    clean = lambda i: " ".join(f"{names[(i * 7 + k * (1 + i % 5)) % 12]} {names[(i + k * k) % 12]}{i} and then it was the {names[(i * k) % 12]}." for k in range(12))
    rows = [(i, clean(i), "en", f"s{i % 4}", 0) for i in range(200)]
    rows += [(1000 + i, "$$$ ### *** %%% &&& " * (10 + i % 7) + str(i), "en", "s1", 0) for i in range(80)]
    rows += [(2000 + i, clean(i).upper() if i % 2 else clean(i), "en", "s2", 0) for i in range(20)]
    rows += [(3000 + i, clean(i) + " one more", "en", "s3", 0) for i in range(100, 120)]
    clashing(docs(spark, rows)).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], 0 if 1000 <= r[0] < 2000 else 1, 0) for r in rows if r[0] % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows


def test_stages_against_brute_force(spark, sf, tmp_path):
    path, rows = sf
    source = spark.read.parquet(f"{path}/documents.parquet")
    df, seen = source, {}
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, df, path).write.parquet(out)
        df = spark.read.parquet(out)
        seen[name] = df
        if name != "encode":
            assert df.columns == source.columns
    text = {r[0]: r[1] for r in rows}
    ids = lambda n: sorted(r["doc_id"] for r in seen[n].select("doc_id").collect())

    quality = ids("quality")
    assert quality == sorted(i for i in text if not 1000 <= i < 2000)  # junk goes, clean stays
    best = {}
    for i in quality:
        best[text[i].translate(AZ)] = max(i, best.get(text[i].translate(AZ), -1))
    assert ids("exact_dedup") == sorted(best.values())
    left = ids("near_dedup")
    sets = {i: shingle_set(text[i]) for i in best.values()}
    similar = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    for i in best.values():
        assert (i in left) == (not any(similar(i, j) for j in best.values() if j < i))
    mixed = Counter(ids("mix"))
    assert set(mixed) <= set(left) and max(mixed.values()) <= 3
    ranks = load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = seen["encode"].collect()
    assert Counter(r["doc_id"] for r in coded) == mixed
    for r in coded:
        assert list(r["ids"]) == enc.encode_ordinary(text[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])
    assert zlib.crc32(b"") == 0


def test_run_and_registration(spark, sf):
    import __spark_entry__ as E

    path, _ = sf
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and E.queries()["pipeline"]
    assert corpus_pipeline.run(spark, path).count() > 100


def test_python_steps_of_encode_get_batches_of_bounded_bytes(spark, sf):
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    rows = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('wide ', 1000) AS text")
    before = spark.conf.get(ARROW_BYTES, None)
    spark.conf.unset(ARROW_BYTES)
    try:
        dict(corpus_pipeline.STAGES)["encode"](spark, rows.limit(0), "")
        got = rows.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r["n"] for r in got) == 3000 and max(r["size"] for r in got) < 5 << 20  # 15 MB in one batch else

        spark.conf.set(ARROW_BYTES, "9m")  # the session's own choice stays
        dict(corpus_pipeline.STAGES)["encode"](spark, rows.limit(0), "")
        assert spark.conf.get(ARROW_BYTES) == "9m"

        spark.conf.unset(ARROW_BYTES)
        corpus_pipeline.run(spark, sf[0])
        assert spark.conf.get(ARROW_BYTES, None) is None  # as it was
    finally:
        spark.conf.unset(ARROW_BYTES) if before is None else spark.conf.set(ARROW_BYTES, before)


def test_empty(spark, tmp_path):
    docs(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_near_stage_on_a_crowded_family(spark, monkeypatch):
    """Template texts just under 0.8 over many chunks: each planted pair at 0.80 to 0.85 keeps one text, the others all stay."""
    monkeypatch.setattr(near_dedup, "CHUNK", 40)
    monkeypatch.setattr(near_dedup, "OVERLAP", 10)
    rows = crowded(400, 40)
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    left = sorted(r["doc_id"] for r in stage(spark, docs(spark, rows), "").select("doc_id").collect())
    assert left == sorted(set(range(400)) - {2 * p + 1 for p in range(40)})
