import os
import random
import time
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from dialogprep.llm import near_dedup
from dialogprep.llm.dartminhash import signatures
from dialogprep.llm.near_dedup import components, drop_near_copies, near_classes
from tests.llm.helpers import HARD, clashing, docs


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def brute(rows):
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [shingle_set(r[1]) for r in rows]
    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a == b or len(a & b) >= 0.8 * len(a | b):
            parent[root(i)] = root(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[root(i)].append(i)
    least = {k: min((rows[i][0] for i in v if rows[i][0] is not None), default=None) for k, v in members.items()}
    return sorted(((rows[i][0], least[root(i)], len(members[root(i)])) for i in range(len(rows))), key=repr)


def got(df):
    return sorted((tuple(r) for r in near_classes(df).select("id", "class_id", "class_size").collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 6)))
    rows = list(HARD)
    base = [word() for _ in range(120)]
    for i in range(150):  # a dense group around the threshold, no clique
        w = list(base)
        for _ in range(rnd.randint(0, 5)):
            w[rnd.randrange(len(w))] = word()
        rows.append((1000 + i, " ".join(w), "en", "s", 0))
    for g in range(15):  # pairs and chains
        w = [word() for _ in range(rnd.randint(3, 200))]
        for k in range(3):
            rows.append((2000 + 10 * g + k, " ".join(w), "en", "s", 0))
            w = w[:]
            w[rnd.randrange(len(w))] = word()
    rows += [(3000 + i, " ".join(word() for _ in range(60)) + " " + " ".join(base[:30]), "en", "s", 0) for i in range(100)]  # a shared passage
    return rows


def test_equals_all_pairs(spark, corpus):
    assert got(clashing(docs(spark, corpus))) == brute(corpus)


def test_small_chunks_find_the_same(spark, corpus, monkeypatch):
    """A group that spans many chunks and ranges."""
    monkeypatch.setattr(near_dedup, "CHUNK", 40)
    monkeypatch.setattr(near_dedup, "OVERLAP", 10)
    monkeypatch.setattr(near_dedup, "MEMBERS_PER_RANGE", 200)
    a, b = dict((x[0], x[1]) for x in got(docs(spark, corpus))), dict((x[0], x[1]) for x in brute(corpus))
    assert sum(a[k] != b[k] for k in b) <= 0.01 * len(b)


@pytest.mark.parametrize("a,b,want", [((300, 0), (0, 300), 0.0), ((300, 0), (300, 0), 1.0), ((400, 0), (300, 100), 0.6), ((90, 0), (90, 10), 0.9), ((8, 0), (8, 2), 0.8)])
def test_agreement_is_similarity(a, b, want):
    rnd = np.random.default_rng(5)
    hits = []
    for _ in range(12):
        x = rnd.integers(0, 2**63, 600).astype(np.uint64)
        s, t = x[:a[0]], np.concatenate([x[:b[0]], x[len(x) - b[1]:] if b[1] else x[:0]])
        sig = signatures([(s, np.ones(len(s))), (t, np.ones(len(t)))], 256)
        hits.append((sig[0] == sig[1]).mean())
    assert np.mean(hits) == pytest.approx(want, abs=0.035)


def test_weighted_agreement():
    rnd = np.random.default_rng(9)
    hits = []
    for _ in range(20):
        x = rnd.integers(0, 2**63, 100).astype(np.uint64)
        w, v = rnd.uniform(0.2, 4, 100), rnd.uniform(0.2, 4, 100)
        sig = signatures([(x, w), (x, v)], 256)
        hits.append((sig[0] == sig[1]).mean() - np.minimum(w, v).sum() / np.maximum(w, v).sum())
    assert abs(np.mean(hits)) < 0.02


def test_signature_does_not_depend_on_the_batch():
    rnd = np.random.default_rng(1)
    sets = [(np.unique(rnd.integers(0, 2**63, n).astype(np.uint64)), None) for n in (1, 2, 7, 60, 61, 500, 4000)]
    sets = [(e, np.ones(len(e))) for e, _ in sets] + [(np.zeros(0, np.uint64), np.zeros(0))]
    together = signatures(sets, 256)
    for i, s in enumerate(sets):
        assert (signatures([s], 256)[0] == together[i]).all()
    assert not together[-1].any() and together[:-1].all()


def test_weights_by_count(spark):
    rows = [(1, "a b c d e " * 30 + "x y z u v", "en", "s", 0), (2, "a b c d e " * 3 + "x y z u v", "en", "s", 0)]
    n = lambda w: len({r["class_id"] for r in near_classes(docs(spark, rows), weights=w).collect()})
    assert (n("set"), n("count")) == (1, 2)


def test_components_of_a_long_path(spark):
    names = [b"%05d" % i for i in range(60)]
    edges = [(names[i], names[i + 1]) for i in range(40)] + [(names[50], names[55]), (names[55], names[52])]
    df = components(spark.createDataFrame(edges, "a binary, b binary"))
    roots = {bytes(r["node"]): bytes(r["root"]) for r in df.collect()}
    assert all(roots[n] == names[0] for n in names[:41]) and {roots[names[i]] for i in (50, 52, 55)} == {names[50]}
    assert Counter(roots.values())[names[0]] == 41


def test_drop_keeps_one_whole_row_of_each_class(spark, corpus):
    df = clashing(docs(spark, corpus))
    kept = drop_near_copies(df)
    assert kept.columns == df.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=repr)
    want = {c for _, c, _ in brute(corpus)}
    assert [i for i in ids if i is not None] == sorted((c for c in want if c is not None), key=repr)


def test_empty(spark):
    assert near_classes(docs(spark, [])).collect() == []
    assert drop_near_copies(docs(spark, [])).collect() == []


def crowded(n=400, pairs=40, seed=3):
    """A template family at mutual 0.778; the first ``pairs`` pairs share more and are at 0.80 to 0.85."""
    rnd = random.Random(seed)
    head = " ".join(f"t{i}" for i in range(200))
    tail = [[f"d{rnd.getrandbits(60)}" for _ in range(28)] for _ in range(n)]
    for p in range(pairs):
        shared = 4 + p % 6
        tail[2 * p + 1][:shared] = tail[2 * p][:shared]
    rows = [(i, head + " " + " ".join(t), "en", "hot", 0) for i, t in enumerate(tail)]
    rnd.shuffle(rows)
    return rows


def test_crowded_family_just_under_the_threshold(spark):
    rows = crowded()
    want = brute(rows)
    assert Counter(size for _, _, size in want) == {1: 320, 2: 80}
    assert got(docs(spark, rows)) == want


def test_windows_lose_no_pair(spark, corpus, monkeypatch):
    """Groups over many chunks and ranges, without a tolerated loss."""
    monkeypatch.setattr(near_dedup, "CHUNK", 40)
    monkeypatch.setattr(near_dedup, "OVERLAP", 10)
    monkeypatch.setattr(near_dedup, "MEMBERS_PER_RANGE", 200)
    rows = corpus + [(10_000 + r[0], *r[1:]) for r in crowded(200, 20)]
    assert got(docs(spark, rows)) == brute(rows)


def test_pairs_across_range_borders(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "MEMBERS_PER_RANGE", 1)
    rnd = random.Random(8)
    rows = []
    for g in range(6):
        w = [f"w{rnd.getrandbits(40)}" for _ in range(100)]
        rows += [(2 * g, " ".join(w), "en", "s", 0), (2 * g + 1, " ".join(w[:95]), "en", "s", 0)]
    assert got(docs(spark, rows)) == brute(rows)


def test_isolated_pairs_whose_sketch_misses(spark):
    """Pairs at 0.8 that share a band, in groups of two, whose estimate is below the margin."""
    rnd = random.Random(21)
    rows, hashes = [], near_dedup.WordHash()
    while len(rows) < 4:
        w = [f"w{rnd.getrandbits(40)}" for _ in range(104)]
        v = w[:84]
        sets = [near_dedup._weighted(near_dedup._words(" ".join(x)), hashes, "set") for x in (w, v)]
        a, b = signatures(sets, near_dedup.K)
        same = (a == b)[:near_dedup.BANDS * near_dedup.ROWS].reshape(near_dedup.BANDS, near_dedup.ROWS).all(axis=1)
        if np.mean(a == b) < 0.725 and same.any():
            rows += [(len(rows) + i, " ".join(x), "en", "s", 0) for i, x in enumerate((w, v))]
    want = brute(rows)
    assert all(size == 2 for _, _, size in want)
    assert got(docs(spark, rows)) == want


def test_rare_pairs_are_all_pairs(spark, corpus):
    """The join on rare shingles alone, against all pairs, for sets and multisets."""
    texts = sorted({(r[1] or "").lower() for r in corpus + crowded(100, 10)} - {"", " \t\n "})
    hashes = near_dedup.WordHash()
    for weights in ("set", "count"):
        sets = [near_dedup._weighted(near_dedup._words(t), hashes, weights) for t in texts]
        flat = [near_dedup._elements(e.tobytes(), c.astype(np.int32).tobytes() if weights == "count" else None) for e, c in sets]
        flat = [frozenset(x.tolist()) for x in flat]
        want = {(i, j) for i, j in combinations(range(len(texts)), 2) if len(flat[i] & flat[j]) >= 0.8 * len(flat[i] | flat[j])}
        rows = [(b"%06d" % i, b"%06d" % i, e.tobytes(), c.astype(np.int32).tobytes() if weights == "count" else None) for i, (e, c) in enumerate(sets)]
        df = spark.createDataFrame(rows, "node binary, root binary, elements binary, counts binary")
        found = {(int(bytes(r["a"])), int(bytes(r["b"]))) for r in near_dedup.rare_pairs(df, 0.8).collect()}
        assert want <= found and len(want) > 100


def test_written_steps_let_go_of_their_shuffle_files(spark, corpus):
    """While the operator runs, the disk holds the shuffles of the current step, not those of all before."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {f.split("_")[1] for d in disk.localDirsString() for _, _, files in os.walk(d) for f in files if f.startswith("shuffle_")}

    setting, before = spark.conf.get(name, None), shuffles()
    near_classes(docs(spark, corpus))
    for _ in range(50):  # files go in the background
        if len(left := shuffles() - before) <= 8:
            break
        time.sleep(0.2)
    assert len(left) <= 8  # of the few counts that are not written
    assert spark.conf.get(name, None) == setting


def test_component_search_reads_a_joined_edge_once(spark, monkeypatch):
    """Its joins make rows by the number of edges, not by edges times rounds."""
    rnd = random.Random(4)
    names = [b"%05d" % i for i in range(200)]
    edges = {tuple(sorted(rnd.sample(names[:120], 2))) for _ in range(3000)}
    edges |= {(names[i], names[i + 1]) for i in range(110, 199)}  # a long way out of the dense part
    df = spark.createDataFrame(sorted(edges), "a binary, b binary").localCheckpoint()
    kind, made = type(df), []
    join = kind.join

    def counted(self, *args, **kwargs):
        out = join(self, *args, **kwargs)
        made.append(out.count())
        return out

    monkeypatch.setattr(kind, "join", counted)
    found = components(df)
    monkeypatch.undo()
    assert {bytes(r["node"]): bytes(r["root"]) for r in found.collect()} == dict.fromkeys(names, names[0])
    assert sum(made) <= 3 * len(edges)


def test_components_go_on_from_known_ones(spark):
    """Added edges join known parts and new nodes, to the least of both."""
    name = lambda i: b"%05d" % i
    frame = lambda pairs: spark.createDataFrame([(name(a), name(b)) for a, b in pairs], "a binary, b binary")
    first, more = [(1, 2), (2, 3), (10, 11), (20, 21), (30, 31)], [(3, 21), (0, 11), (40, 41), (11, 41), (1, 3)]
    both = components(frame(first + more))
    grown = components(frame(more), components(frame(first)))
    pairs = [sorted((bytes(r["node"]), bytes(r["root"])) for r in x.collect()) for x in (both, grown)]
    assert pairs[0] == pairs[1]
    assert dict(pairs[1]) == {name(k): name(v) for k, v in {1: 1, 2: 1, 3: 1, 20: 1, 21: 1, 0: 0, 10: 0, 11: 0, 40: 0, 41: 0, 30: 30, 31: 30}.items()}
    same = components(frame([]), components(frame(first)))
    assert {bytes(r["root"]) for r in same.collect()} == {name(i) for i in (1, 10, 20, 30)}
