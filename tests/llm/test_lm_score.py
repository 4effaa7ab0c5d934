import math
import zlib
from collections import Counter

import numpy as np
import pytest

from dialogprep.llm import lm_score
from dialogprep.llm.lattice import BEGIN, Lattice, load_pieces, prior
from dialogprep.llm.queries import LM_VOCABULARY
from tests.llm.helpers import HARD, clashing, docs


def toks(text):
    return (text or "").encode().lower().split()


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def brute_base(rows):
    c, n_docs = Counter(), 0
    for r in rows:
        if not held(r[0]):
            c.update(toks(r[1]))
            n_docs += 1
    n, v = sum(c.values()) + n_docs, len(c) + (1 if n_docs else 0)
    p = lambda x: math.log10((x + 0.1) / (n + 0.1 * (v + 1)))
    out = []
    for r in rows:
        w = toks(r[1])
        out.append((r[0], held(r[0]), len(w) + 1, sum(c[x] > 0 for x in w) + (n_docs > 0), n, sum(p(c[x]) for x in w) + p(n_docs)))
    return out


def segmentations(pieces, logs, byte, word):
    """Sum over all cuts, one by one."""
    if not word:
        return 1.0
    total = 0.0
    for j in range(1, len(word) + 1):
        p = pieces.get(word[:j])
        if p is not None:
            total += math.exp(logs[p]) * segmentations(pieces, logs, byte, word[j:])
        elif j == 1:
            total += math.exp(byte * len(word[0].encode())) * segmentations(pieces, logs, byte, word[1:])
    return total


PIECES = ["a", "b", "ab", "ba", "aba", "abab", "é", BEGIN, BEGIN + "a"]
SMALL = Lattice(PIECES, np.log(np.array([.2, .1, .1, .05, .1, .05, .1, .2, .1])), math.log(.01))


@pytest.mark.parametrize("word", ["", "a", "abab", "ababab", BEGIN + "abba", "xé", "中a", "\U0001F600", "ab" * 7])
def test_lattice_sums_all_segmentations(word):
    index = {p: i for i, p in enumerate(PIECES)}
    want = math.log(segmentations(index, SMALL.log_p, SMALL.log_byte, word))
    assert SMALL.score([word])[0] == pytest.approx(want, abs=1e-9)
    assert SMALL._one(word) == pytest.approx(want, abs=1e-9)


def test_long_words_and_batches_agree():
    words = ["ab" * n + "a" for n in (1, 5, 20, 23, 24, 30, 200)] + ["a" * 49, "é" * 48, ""]
    assert SMALL.score(words) == pytest.approx([SMALL._one(w) for w in words], abs=1e-8)


def test_expected_uses():
    # 'ab' is cut as ab or a + b.
    e = SMALL.expected(["ab"], np.array([3.0]))
    whole, parts = .1, .2 * .1
    assert e[PIECES.index("ab")] == pytest.approx(3 * whole / (whole + parts))
    assert e[PIECES.index("a")] == e[PIECES.index("b")] == pytest.approx(3 * parts / (whole + parts))


def all_cuts(word):
    """Every segmentation of ``word`` as pieces and log-probability."""
    index = {p: i for i, p in enumerate(PIECES)}
    if not word:
        yield [], 0.0
    for j in range(1, len(word) + 1):
        p = index.get(word[:j])
        if p is not None or j == 1:
            lp = SMALL.log_p[p] if p is not None else SMALL.log_byte * len(word[0].encode())
            for rest, more in all_cuts(word[j:]):
                yield ([p] if p is not None else []) + rest, lp + more


@pytest.mark.parametrize("word", ["a", "abab", BEGIN + "abba", "xéab", "中a", "ab" * 5 + "xaba"])
def test_expected_uses_equal_all_segmentations(word):
    cuts = list(all_cuts(word))
    every = sum(math.exp(lp) for _, lp in cuts)
    want = np.zeros(len(PIECES))
    for used, lp in cuts:
        for p in used:
            want[p] += 2 * math.exp(lp) / every
    one = np.zeros(len(PIECES))
    SMALL._expected_one(word, 2.0, one)
    assert one == pytest.approx(want)
    assert SMALL.expected([word], np.array([2.0])) == pytest.approx(want)


@pytest.mark.parametrize("at", [0, 41, 46, 47, 48, 60, 95, 300])
def test_expected_uses_in_long_words_have_no_cuts(at):
    """A three-letter piece counts the same wherever it stands, and only a begin is a begin."""
    word = BEGIN + "x" * at + "aba" + "x" * (400 - at)
    e = SMALL.expected([word, "aba"], np.array([1.0, 0.0]))
    alone = SMALL.expected(["aba"], np.array([1.0]))
    assert e[PIECES.index("aba")] == pytest.approx(alone[PIECES.index("aba")], rel=.5 if at == 0 else 1e-6)
    assert e[PIECES.index(BEGIN)] + e[PIECES.index(BEGIN + "a")] == pytest.approx(1.0)
    assert SMALL.expected(["ab" * 10_000], np.array([1.0]))[PIECES.index("ab")] > 100


def test_document_score_equals_brute_force(spark, rows):
    """The model made again in plain Python, word by word, and each document's sum."""
    c, n_docs = Counter(), 0
    for r in rows:
        if not held(r[0]):
            c.update(toks(r[1]))
            n_docs += 1
    pieces, scores = load_pieces(LM_VOCABULARY)
    p = prior([*scores, max(scores), min(scores)])
    first = Lattice(pieces, np.log(p[:-2]), float(np.log(p[-1])))
    uses = np.zeros(len(p))
    for w, n in c.items():
        first._expected_one(BEGIN + w.decode(), n, uses[:-2])
    uses[-2] = n_docs
    q = uses + lm_score.PRIOR * p
    q = np.log(q / q.sum())
    model = Lattice(pieces, q[:-2], float(q[-1]))
    got = lm_score.score_documents(docs(spark, rows), LM_VOCABULARY).collect()
    want = [(r[0], len(toks(r[1])) + 1, (sum(n * model._one(BEGIN + w.decode()) for w, n in Counter(toks(r[1])).items()) + q[-2]) / math.log(10)) for r in rows]
    key = lambda x: (repr(x[0]), x[1], x[2])
    assert [x[2] for x in sorted(((r["id"], r["n_tokens"], r["score"]) for r in got), key=key)] == pytest.approx([w[2] for w in sorted(want, key=key)], rel=1e-9)


def test_prior_and_vocabulary():
    pieces, scores = load_pieces(LM_VOCABULARY)
    p = prior(scores)
    assert len(pieces) == len(p) > 30_000 and p.sum() == pytest.approx(1.0)
    assert p[np.argmax(scores)] == p.max()


@pytest.fixture(scope="module")
def rows():
    more = [(100 + i, f"common Words here{i % 7} and rare{i} Ünique{i}", "en", "s", 0) for i in range(80)]
    return HARD + more + [more[3], more[3]]


@pytest.mark.parametrize("heavy", [lm_score.HEAVY, 20, 1])
def test_base_equals_brute_force(spark, rows, heavy, monkeypatch):
    """Whatever share of the words is broadcast."""
    monkeypatch.setattr(lm_score, "HEAVY", heavy)
    got = sorted((tuple(r) for r in clashing(docs(spark, rows)).transform(lm_score.score_documents, LM_VOCABULARY).collect()), key=repr)
    want = sorted(brute_base(rows), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9)
    assert all(g[6] < 0 for g in got)


def test_model_prefers_training_language(spark):
    rows = [(i, " ".join(f"{a}{b}" for a in ("inter", "over") for b in ("nation", "look", f"take{i % 5}")), "en", "s", 0) for i in range(200)]
    rows += [(1000, "internation overlook", "en", "s", 0), (1001, "qzxjv kqwzzx", "en", "s", 0)]
    got = {r["id"]: r for r in lm_score.score_documents(docs(spark, rows), LM_VOCABULARY).collect()}
    assert got[1000]["score"] > got[1001]["score"]


def test_nothing_to_train_on(spark):
    only_held = [(i, "a b", "en", "s", 0) for i in range(200) if held(i)]
    got = lm_score.score_documents(docs(spark, only_held), LM_VOCABULARY).collect()
    assert len(got) == len(only_held) and all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in got)
    assert lm_score.score_documents(docs(spark, []), LM_VOCABULARY).collect() == []
