"""Cheapest edits of a symbol sequence into an automaton's language, block by block.

A sequence is rows, each one of ``SYMBOLS`` symbols; edits keep, re-role, delete or
insert (costs below) so that the output's role initials match ``(s?(ua)+)?``.  The
cost to go from a place is a vector with one entry per automaton state; less its
least entry it is one of few normalised vectors, so:

* the tables hold, for every normalised vector behind a block and every block of
  ``BLOCK`` symbols, the normalised vector before it and the amount taken off;
* costs are computed from the right, one lookup a block;
* edits are traced from the left: a block is expanded backward from the vector
  behind it, and in each place the ASCII-least letter that keeps the least cost
  is taken, which gives the ASCII-least of the cheapest edit strings.  Traces of
  (block, vector, state) are kept, as texts repeat them.
"""

from __future__ import annotations

import functools

import numpy as np

# Costs of the edits, the states of (s?(ua)+)? and its moves.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES = 4
MOVES = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
ACCEPTING = (START, AFTER_A)
INF = 1 << 40

# Symbols: initial s, u, a or another of a sound row, the same of a truncated one, and a row that must go.
INITIALS = "sua"
SYMBOLS = 9
GONE = 8
BLOCK = 4


def moves(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits that use up a row, in ASCII order."""
    out = [("D", DELETE, state)]
    if symbol != GONE:
        more = TRUNCATED if symbol >= 4 else 0
        initial = (INITIALS + "?")[symbol % 4]
        if (state, initial) in MOVES:
            out.append(("K", KEEP + more, MOVES[state, initial]))
        out += [("R", REROLE + more, MOVES[state, r]) for r in "ua" if (state, r) in MOVES]
    return out


def inserted(state: int) -> int:
    """The state after the one insertion that a state allows (none can insert an s)."""
    return MOVES[state, "a" if state == AFTER_U else "u"]


def close(f: list[int]) -> tuple[int, ...]:
    """Costs to go when insertions may come first."""
    f = list(f)
    for _ in range(STATES):
        f = [min(f[s], INSERT + f[inserted(s)]) for s in range(STATES)]
    return tuple(min(x, INF) for x in f)


def step(symbol: int, f: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go before a row, from those behind it."""
    return close([min(c + f[t] for _, c, t in moves(symbol, s)) for s in range(STATES)])


END = close([0 if s in ACCEPTING else INF for s in range(STATES)])


def normal(f: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    low = min(f)
    return (f, 0) if low >= INF else (tuple(INF if x >= INF else x - low for x in f), low)


class Tables:
    """Vectors reachable from the end and from each single state, and the tables over them."""

    def __init__(self):
        # A vector that is finite at one state only is the border of a piece whose continuation is not known yet.
        starts = [END, *(close([0 if t == s else INF for t in range(STATES)]) for s in range(STATES))]
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        todo = [normal(f)[0] for f in starts]
        edges = {}
        while todo:
            f = todo.pop()
            if f in self.number:
                continue
            self.number[f] = len(self.vectors)
            self.vectors.append(f)
            edges[f] = [normal(step(c, f)) for c in range(SYMBOLS)]
            todo += [g for g, _ in edges[f]]
        one = np.array([[self.number[g] for g, _ in edges[f]] for f in self.vectors])
        off = np.array([[o for _, o in edges[f]] for f in self.vectors])
        self.one, self.off = one, off
        # A block's number reads its symbols as digits, the first one highest; the last one is taken first.
        self.to, self.take = one, off
        for n in range(1, BLOCK):
            first, rest = np.divmod(np.arange(SYMBOLS ** (n + 1)), SYMBOLS ** n)
            mid = self.to[:, rest]
            self.to, self.take = one[mid, first], self.take[:, rest] + off[mid, first]
        self.end = self.at(END)[0]
        self.trace = functools.lru_cache(maxsize=1 << 16)(self._trace)

    def at(self, f: tuple[int, ...]) -> tuple[int, int]:
        """(number, amount) of a vector; one that the tables lack has no number yet and gets one."""
        g, low = normal(f)
        if g not in self.number:
            raise KeyError(f)
        return self.number[g], low

    def blocks(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the whole blocks, and the symbols behind them."""
        n = len(symbols) // BLOCK * BLOCK
        return symbols[:n].reshape(-1, BLOCK).astype(np.int64) @ SYMBOLS ** np.arange(BLOCK - 1, -1, -1), symbols[n:]

    def back(self, symbols: np.ndarray, vector: int) -> tuple[int, int, list[int]]:
        """(vector before, amount, vectors behind each block) of a sequence before ``vector``."""
        whole, rest = self.blocks(symbols)
        total = 0
        for c in rest[::-1].tolist():
            total += int(self.off[vector, c])
            vector = int(self.one[vector, c])
        behind = []
        for b in whole[::-1].tolist():
            behind.append(vector)
            total += int(self.take[vector, b])
            vector = int(self.to[vector, b])
        return vector, total, behind[::-1]

    def _trace(self, symbols: bytes, vector: int, state: int) -> tuple[str, int]:
        """ASCII-least cheapest letters of a few rows before ``vector``, entered in ``state``, and the exit state."""
        behind = [self.vectors[vector]]
        for c in symbols[::-1]:
            behind.append(step(c, behind[-1]))
        behind.reverse()
        out, i = [], 0
        while i < len(symbols):
            here = behind[i][state]
            options = [("I", INSERT, inserted(state), 0)] + [(letter, cost, to, 1) for letter, cost, to in moves(symbols[i], state)]
            letter, _, state, used = min(o for o in options if o[1] + behind[i + o[3]][o[2]] == here)
            out.append(letter)
            i += used
        return "".join(out), state

    def edits(self, symbols: np.ndarray, vector: int, state: int) -> tuple[str, int]:
        """:meth:`_trace` of any number of rows, one block after the other."""
        cut = len(symbols) // BLOCK * BLOCK
        rest = symbols[cut:].astype(np.uint8).tobytes()
        mid = self.back(symbols[cut:], vector)[0] if rest else vector
        behind = self.back(symbols[:cut], mid)[2]
        raw, out = symbols[:cut].astype(np.uint8).tobytes(), []
        for n, v in enumerate(behind):
            letters, state = self.trace(raw[n * BLOCK:(n + 1) * BLOCK], v, state)
            out.append(letters)
        letters, state = self.trace(rest, vector, state)
        return "".join(out) + letters, state

    def ending(self, state: int) -> str:
        """Insertions behind the last row."""
        out = ""
        while state not in ACCEPTING:
            out, state = out + "I", inserted(state)
        return out

    def piece(self, symbols: np.ndarray) -> list[list[int]]:
        """Cost matrix of a piece: row s, column t = cheapest way through from state s to t."""
        columns = []
        for t in range(STATES):
            v, low = self.at(close([0 if s == t else INF for s in range(STATES)]))
            vector, total, _ = self.back(symbols, v)
            columns.append([min(INF, x + total + low) for x in self.vectors[vector]])
        return [list(r) for r in zip(*columns, strict=True)]


@functools.lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def before(piece: list[list[int]], f: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go before a piece, from those behind it."""
    return tuple(min(INF, min(c + x for c, x in zip(row, f, strict=True))) for row in piece)
