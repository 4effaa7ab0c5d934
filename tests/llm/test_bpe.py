import hashlib
import random
import tracemalloc

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from dialogprep.llm import bpe
from dialogprep.llm.bpe import KEPT_BYTES, BytePairCodec, Vocabulary, decode, encode, ids_text, load_ranks, merge
from dialogprep.llm.queries import op8_byte_bpe
from tests.llm.helpers import HARD, clashing, docs

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = load_ranks(PATH)
VOCABULARY = Vocabulary(RANKS)
OURS = BytePairCodec(VOCABULARY, P.PATTERN)
THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=400))
def test_any_text(text):
    ids = OURS.encode(text)
    assert ids == THEIRS.encode_ordinary(text)
    assert OURS.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abtheinr", min_size=KEPT_BYTES, max_size=1500))
def test_long_pieces_need_joins(text):
    assert OURS.encode(text) == THEIRS.encode_ordinary(text)


@pytest.mark.parametrize("alphabet", ["a", "ab", "-=", "0123456789", "é中aß", " ", "\n ", "ACGT"])
@pytest.mark.parametrize("n", [1, 47, 48, 49, 97, 1000, 5000])
def test_repetitive_pieces(alphabet, n):
    rnd = random.Random(n)
    text = "".join(rnd.choice(alphabet) for _ in range(n))
    assert OURS.encode(text) == THEIRS.encode_ordinary(text)


def ranks_of(raw):
    return tuple(RANKS[p] for p in merge(RANKS, raw))


def test_join_is_associative_on_any_cut():
    raw = ("theinterationalization" * 12).encode()
    whole = ranks_of(raw)
    for cut in range(0, len(raw), 5):
        assert OURS.join(ranks_of(raw[:cut]), ranks_of(raw[cut:])) == whole


def test_stable_pairs_are_what_merging_gives():
    rnd = random.Random(1)
    tokens = list(VOCABULARY.tokens.items())
    short = [t for t in tokens if len(t[0]) <= 4]
    same = [(t, t) for t in rnd.sample(tokens, 3000)]
    runs = [((b"a" * i, RANKS[b"a" * i]), (b"a" * j, RANKS[b"a" * j])) for i in range(1, 9) for j in range(1, 9)
            if b"a" * i in VOCABULARY.tokens and b"a" * j in VOCABULARY.tokens]
    for (a, i), (b, j) in [(rnd.choice(tokens), rnd.choice(tokens)) for _ in range(10_000)] + [(rnd.choice(short), rnd.choice(short)) for _ in range(20_000)] + same + runs:
        assert OURS._stable(i, j) == (ranks_of(a + b) == (i, j)), (a, b)


def test_every_piece_that_is_no_token_goes_through_joins():
    codec = BytePairCodec(VOCABULARY, P.PATTERN)
    for piece in ("qzxv", "zq", "Donaudampfschiff", "xkcdqwertz" * 20):
        before = codec.joins
        assert list(codec.encode_piece(piece)) == THEIRS.encode_ordinary(piece)
        assert codec.joins > before


def test_operator_round_trip(spark):
    rows = HARD + [(100, "<|endoftext|> 'll it's", "en", "s", 0)]
    coded = decode(encode(clashing(docs(spark, rows)), PATH, P.PATTERN), PATH, P.PATTERN)
    got = sorted(((r["id"], list(r["ids"]), bytes(r["bytes"])) for r in coded.collect()), key=repr)
    assert got == sorted(((r[0], THEIRS.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in rows), key=repr)
    text = sorted(r[0] for r in coded.select(ids_text(coded["ids"])).collect())
    assert text == sorted(",".join(map(str, THEIRS.encode_ordinary(r[1] or ""))) for r in rows)


def test_query_digests(spark, tmp_path):
    docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in HARD:
        ids = THEIRS.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), sha(",".join(map(str, ids)).encode()), sha((r[1] or "").encode())))
    got = [tuple(r) for r in op8_byte_bpe(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_a_worker_stays_small_over_ever_new_words():
    rnd = random.Random(4)
    codec = BytePairCodec(VOCABULARY, P.PATTERN)
    tracemalloc.start()
    try:
        for _ in range(80):
            text = " ".join("".join(rnd.choices("aeinrstlou", k=9)) for _ in range(5000))
            packed = codec.encode_packed(text)
            assert codec.encode_packed(text) == packed  # from the cache
        del text, packed
        assert tracemalloc.get_traced_memory()[0] < 55e6
    finally:
        tracemalloc.stop()


def test_decoding_needs_no_merge_tables(spark, monkeypatch):
    rows = spark.createDataFrame([(i, THEIRS.encode_ordinary(t)) for i, t in enumerate(["", "the theory", "é中"])], "id long, ids array<int>")
    monkeypatch.setattr(bpe, "_vocabularies", {})
    monkeypatch.setattr(bpe, "Vocabulary", None)
    assert sorted((r["id"], bytes(r["bytes"]).decode()) for r in decode(rows, PATH, P.PATTERN).collect()) == [(0, ""), (1, "the theory"), (2, "é中")]


def test_empty(spark):
    assert encode(docs(spark, []), PATH, P.PATTERN).collect() == []
