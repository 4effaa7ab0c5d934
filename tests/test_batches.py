import random

import pytest

from dialogprep.operators import collate, pack


def collate_ref(rows, bs, pad):
    """Plain restatement of the reference collator, per batch of ``bs`` rows."""
    out = {}
    for b in range(0, len(rows), bs):
        batch = rows[b:b + bs]
        n = max(len(ids) for _, ids, _ in batch)
        for key, ids, lab in batch:
            pids = ids + [pad] * (n - len(ids))
            out[key] = (b // bs, pids, lab + [-100] * (n - len(lab)), [int(x != pad) for x in pids])
    return out


def pack_ref(seqs, block):
    """Plain restatement of the reference's group_texts on one group."""
    cat = [x for s in seqs for x in s]
    total = len(cat)
    if total == 0:
        return []  # intended divergence: an all-empty group yields nothing
    total = (total // block) * block if total >= block else block
    return [cat[i:i + block] for i in range(0, total, block)]


def _df(spark, rows):
    return spark.createDataFrame(rows, "example_id long, input_ids array<int>, labels array<int>")


@pytest.mark.parametrize("n,bs", [(1, 2), (5, 2), (4, 4), (7, 3)])
def test_collate_matches_restatement(spark, n, bs):
    rng = random.Random(n * 10 + bs)
    pad = 2
    rows = []
    for k in range(n):
        ids = [rng.choice([2, 5, 6, 7]) for _ in range(rng.randint(1, 6))]  # pad id inside ids too
        rows.append((k, ids, [-100] + ids[1:]))
    got = {r["example_id"]: (r["batch_id"], r["ids"], r["labels"], r["mask"])
           for r in collate(_df(spark, rows), bs, pad, order="key").collect()}
    assert got == collate_ref(rows, bs, pad)


def test_collate_mask_by_length(spark):
    rows = [(0, [5, 2], [5, 2]), (1, [5, 6, 7], [5, 6, 7])]
    got = {r["example_id"]: r["mask"] for r in collate(_df(spark, rows), 2, 2, mask="by_length", order="key").collect()}
    assert got == {0: [1, 1, 0], 1: [1, 1, 1]}


@pytest.mark.parametrize("sizes,block", [([3, 2], 8), ([4, 4], 8), ([5, 4], 8), ([3, 0, 6, 0, 9], 4),
                                         ([0, 0], 4), ([17], 4)])
def test_pack_matches_restatement(spark, sizes, block):
    rows, seqs, n = [], [], 0
    for k, s in enumerate(sizes):
        ids = list(range(n, n + s))
        n += s
        rows.append((k, ids, [-x for x in ids]))
        seqs.append(ids)
    got = sorted(pack(_df(spark, rows), block, cols=("input_ids", "labels")).collect(), key=lambda r: r["chunk"])
    want = pack_ref(seqs, block)
    assert [r["input_ids"] for r in got] == want
    assert [r["labels"] for r in got] == [[-x for x in c] for c in want]


def test_pack_per_group_random(spark):
    rng = random.Random(3)
    rows = [(k, [rng.randint(16, 99) for _ in range(rng.randint(0, 30))]) for k in range(60)]
    rows = [(k, ids, ids) for k, ids in rows]
    got = pack(_df(spark, rows), 16, group_rows=7, cols=("input_ids", "labels"))
    got = sorted(((r["group"], r["chunk"]), r["input_ids"]) for r in got.collect())
    want = []
    for g in range(0, 60, 7):
        for c, chunk in enumerate(pack_ref([ids for k, ids, _ in rows[g:g + 7]], 16)):
            want.append(((g // 7, c), chunk))
    assert got == sorted(want)


def test_collate_with_shuffle_rank(spark):
    from dialogprep.operators import shuffle

    rows = [(k, [5] * (k % 4 + 1), [5] * (k % 4 + 1)) for k in range(9)]
    ranked = shuffle(_df(spark, rows), "example_id", seed=3)
    got = collate(ranked, 4, 2, rank_col="shuffle_rank", n_shards=2).collect()
    order = sorted(got, key=lambda r: r["shuffle_rank"])
    assert [r["batch_id"] for r in order] == [0, 0, 0, 0, 1, 1, 1, 1, 2]
    assert [r["shard"] for r in order] == [0, 0, 0, 0, 1, 1, 1, 1, 0]
