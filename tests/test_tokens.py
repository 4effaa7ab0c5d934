import pytest
from pyspark.sql import functions as F

from dialogprep.functions import checksum


def test_codepoint_round_trip(spark, tok):
    texts = ["", "abc", "한국어 😀 é\n\"q\"", "a" * 1000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select("t", tok.encode(F.col("t"), add_special=True).alias("ids"))
    out = out.select("t", "ids", tok.decode(F.col("ids")).alias("back"), tok.n_tokens(F.col("t"), True).alias("n"))
    for r in out.collect():
        assert r["back"] == r["t"]
        assert r["ids"][0] == tok.bos_token_id
        assert len(r["ids"]) == r["n"] == len(r["t"]) + 1
        assert r["ids"][1:] == [ord(c) + 16 for c in r["t"]]


def test_empty_string_encodes_to_nothing(spark, tok):
    r = spark.range(1).select(tok.encode(F.lit("")).alias("i")).collect()[0]
    assert r["i"] == []


def test_decode_with_specials_visible(spark, tok):
    r = spark.range(1).select(tok.decode(F.array(F.lit(1), F.lit(16 + ord("h")), F.lit(2)),
                                         skip_special=False).alias("d")).collect()[0]
    assert r["d"] == "<bos>h<eos>"


def test_checksum_matches_python(spark):
    ids = [5, -100, 7, 123456]
    z = 0
    for x in ids:
        z = int((z * 31 + x) - 1000003 * int((z * 31 + x) / 1000003))
    got = spark.range(1).select(checksum(F.array(*[F.lit(i) for i in ids])).alias("c")).collect()[0]["c"]
    assert got == z


def test_piece_tokenizer_round_trip(spark):
    tokenizers = pytest.importorskip("tokenizers")
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers, trainers

    from dialogprep.functions import PieceTokenizer

    t = Tokenizer(models.BPE(unk_token="<unk>"))
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    t.decoder = decoders.ByteLevel()
    trainer = trainers.BpeTrainer(vocab_size=300, special_tokens=["<pad>", "<bos>", "<eos>", "<unk>"],
                                  initial_alphabet=pre_tokenizers.ByteLevel.alphabet())
    corpus = ["hello world", "the quick brown fox", "한국어 문장", "emoji 😀 ok"] * 20
    t.train_from_iterator(corpus, trainer)
    pt = PieceTokenizer(t.to_str())
    df = spark.createDataFrame([(s,) for s in corpus[:4] + [""]], "t string")
    out = df.select("t", pt.encode(F.col("t"), add_special=True).alias("ids"))
    out = out.select("t", "ids", pt.decode(F.col("ids")).alias("back")).collect()
    for r in out:
        assert r["ids"][0] == pt.bos_token_id
        assert r["back"] == r["t"]
    assert tokenizers is not None


def test_byte_level_piece_tokenizer(spark):
    from dialogprep.functions import PieceTokenizer
    from dialogprep.functions.tokens import byte_level_tokenizer_json

    pt = PieceTokenizer(byte_level_tokenizer_json())
    texts = ["", "abc", "é한😀\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", pt.encode(F.col("t"), add_special=True).alias("ids")).select(
        "t", "ids", pt.decode(F.col("ids")).alias("back")).collect()
    for r in rows:
        assert r["ids"] == [pt.bos_token_id] + [b + 3 for b in r["t"].encode()]
        assert r["back"] == r["t"]


def test_piece_tokenizer_takes_a_batch_in_bounded_calls():
    """Whatever an Arrow batch holds, a call gets ``CALL_SIZE`` characters or ids, or one row."""
    pd = pytest.importorskip("pandas")
    from dialogprep.functions import PieceTokenizer, tokens

    pt = PieceTokenizer(tokens.byte_level_tokenizer_json())
    big = tokens.CALL_SIZE // 4
    texts = ["", None] + ["ab" * (big // 2)] * 9 + ["c", "d" * (2 * tokens.CALL_SIZE), "e", ""]
    parts = list(pt._encode_udf(True).func(iter([pd.Series(texts), pd.Series([], dtype=object), pd.Series(["f"])])))
    assert all(len(p) == 1 or sum(len(x) - 1 for x in p) <= tokens.CALL_SIZE for p in parts)
    assert max(len(p) for p in parts) > 1
    ids = [x.tolist() for p in parts for x in p]
    assert ids == [[pt.bos_token_id] + [b + 3 for b in (t or "").encode()] for t in texts + ["f"]]

    back = list(pt._decode_udf(True).func(iter([pd.Series([None] + ids)])))
    assert all(len(p) == 1 or sum(map(len, p)) <= tokens.CALL_SIZE for p in back)
    assert [t for p in back for t in p] == [""] + [t or "" for t in texts + ["f"]]
