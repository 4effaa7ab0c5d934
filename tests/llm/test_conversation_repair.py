"""Conversation repair against a plain search over all rows, states and letters."""

import functools
import hashlib
import random
import zlib

import numpy as np
import pytest

from dialogprep.llm import conversation_repair as cr
from dialogprep.llm import four_russians as fr
from dialogprep.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string"
WS = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, letters, lines) of rows (role, text, fault): all edits, by recursion from each place and state."""

    @functools.lru_cache(maxsize=None)
    def go(i, state, n_ins):
        best = None

        def offer(cost, letter, line, rest):
            nonlocal best
            if rest is not None:
                got = (cost + rest[0], letter + rest[1], line + rest[2])
                best = got if best is None or got[:2] < best[:2] else best

        if i == len(rows) and state in (0, 3):
            best = (0, "", ())
        if n_ins < 3:
            role = "assistant" if state == 2 else "user"
            offer(5, "I", (role + ":",), go(i, 3 if state == 2 else 2, n_ins + 1))
        if i < len(rows):
            role, text, fault = rows[i]
            offer(2, "D", (), go(i + 1, state, 0))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                moves = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[state]
                if role[:1] in moves:
                    offer(extra, "K", (f"{role}:{text}",), go(i + 1, moves[role[:1]], 0))
                for new in ("user", "assistant"):
                    if new[0] in moves:
                        offer(1 + extra, "R", (f"{new}:{text}",), go(i + 1, moves[new[0]], 0))
        return best

    for i in range(len(rows), 0, -1):  # from the end, so that no call goes deep
        for state in range(4):
            go(i, state, 0)
    return go(0, 0, 0)


def brute(rows):
    """op12's result from rows before damage."""
    out = {}
    for conv in {r[0] for r in rows}:
        after = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if d == 1 else "".join(c for c in text if c not in ".!?") if d == 2 else text
            after += [(turn, "user" if d == 4 else role, text)] * {0: 0, 3: 2}.get(d, 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, marked = set(), []
        for _, role, text in after:
            core = text.rstrip(WS)
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = {t for t, _, _ in after if t is not None}
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(marked, marked[1:], strict=False)]
        cost, letters, lines = cheapest(tuple(marked))
        n = [sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *n, sum(p not in ("su", "ua", "au") for p in pairs), cost, letters,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def random_rows(seed, convs=40, long=(7, 400)):
    """Short conversations, one long one; odd roles, nulls, repeats, blanks, gaps."""
    rnd = random.Random(seed)
    rows = []
    for c in [*range(convs), None]:
        n = long[1] if c == long[0] else rnd.randint(1, 9)
        turn = rnd.randint(-3, 5)
        for i in range(n):
            turn += rnd.choice([1, 1, 1, 2])
            role = rnd.choice(["user", "assistant"][i % 2:i % 2 + 1] * 4 + ["system", "user", "assistant", "tool", "", None])
            text = rnd.choice(["Yes.", "No!", f"Is it {i}?", f"cut off {i}", " \t\n", "", None, f"Done {i}. \n", " ", f"wide 中 {i}。", "word " * 50 + "."])
            rows.append((c, None if rnd.random() < 0.05 else turn, role, text))
    rows += [(1000, None, "user", "Hi."), (1000, None, "user", "Hi."), (1001, 5, None, None)]
    rnd.shuffle(rows)
    return rows


def result(spark, monkeypatch, rows, schema=SCHEMA):
    monkeypatch.setattr(queries, "table", lambda *_: spark.createDataFrame(rows, schema))
    got = queries.op12_conversation_repair(spark, "").collect()
    assert len(got) == len({r["conv_id"] for r in got})
    return {r[0]: tuple(r)[1:] for r in got}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_search(spark, monkeypatch, seed):
    rows = random_rows(seed)
    assert result(spark, monkeypatch, rows) == brute(rows)


def test_conversation_over_many_ranges_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(cr, "ROWS", 20)
    monkeypatch.setattr(cr, "PIECE_BYTES", 64)
    rows = random_rows(3, convs=12, long=(5, 300))
    assert result(spark, monkeypatch, rows) == brute(rows)


def test_equal_rows_are_split(spark, monkeypatch):
    """A hot conversation of one repeated row, without turns."""
    monkeypatch.setattr(cr, "ROWS", 10)
    rows = [(5, None, "user", "Hello.")] * 120 + [(6, 1, "user", "A.")]
    assert result(spark, monkeypatch, rows) == brute(rows)


def test_empty(spark, monkeypatch):
    assert result(spark, monkeypatch, []) == {}


def test_dropped_whole(spark, monkeypatch):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert result(spark, monkeypatch, [(conv, 1, "user", "Hi.")]) == {conv: (0, 0, 0, 0, 0, 0, "", empty)}


def test_clashing_columns_and_long_text(spark, monkeypatch):
    rows = [(1, 1, "user", "x" * 3_000_000 + "."), (1, 2, "assistant", " " * 500_000 + "ok" + "\n" * 500_000), (2, 0, "user", "a.")]
    more = "long, ck string, pos long, mark string, r int, letters string, copy int"
    got = result(spark, monkeypatch, [(*r, 9, "k", 1, "m", 2, "l", 3) for r in rows], SCHEMA + ", kind " + more)
    assert got == brute(rows)


def test_blocks_equal_single_steps():
    tab = fr.tables()
    rng = np.random.default_rng(1)
    for n in range(1, 40):
        symbols = rng.integers(0, fr.SYMBOLS, n)
        f = fr.END
        for c in symbols[::-1]:
            f = fr.step(int(c), f)
        vector, total, _ = tab.back(symbols, tab.end)
        assert tuple(x + total for x in tab.vectors[vector]) == f
        cut = n // 2
        assert fr.before(tab.piece(symbols[:cut]), fr.before(tab.piece(symbols[cut:]), fr.END)) == f
