"""Subword lattice: the probability of a word, summed over its segmentations.

A vocabulary of pieces with scores gives each piece a probability; a word's
probability is the sum, over all ways to cut it into pieces, of the product of
their probabilities.  The forward recursion runs in log space over a batch of
words at once: at position ``i`` all words walk the trie of pieces together,
and each piece that ends at ``j`` adds ``alpha[i] + log p`` to ``alpha[j]``.

Characters without a piece of their own fall back to their UTF-8 bytes.
Long words take the same steps one at a time, over the whole word.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np

BEGIN = "▁"  # the mark of a word's begin in the vocabulary
LONG = 48  # longer words go through the recursion one by one
BATCH = 4096
SHIFT = 21  # code points need 21 bits


class Lattice:
    def __init__(self, pieces: list[str], log_p: np.ndarray, log_byte: float):
        self.log_p, self.log_byte = log_p, log_byte
        children: dict[int, int] = {}
        ends: dict[int, int] = {}
        states = 1
        for index, piece in enumerate(pieces):
            state = 0
            for ch in piece:
                key = state << SHIFT | ord(ch)
                state = children.get(key)
                if state is None:
                    state = children[key] = states
                    states += 1
            if piece:
                ends[state] = index
        self.children, self.ends, self.logs = children, ends, log_p.tolist()
        order = sorted(children)
        self.keys = np.array(order or [-1], np.int64)
        self.next = np.array([children[k] for k in order] or [0], np.int64)
        self.end = np.full(states, -1, np.int64)
        self.end[list(ends)] = list(ends.values())
        self.depth = max(map(len, pieces), default=1)

    def _byte_cost(self, codes: np.ndarray) -> np.ndarray:
        return self.log_byte * (1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))

    def _matrix(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lens = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.zeros((len(words), int(lens.max(initial=0))), np.int64)
        codes[np.arange(codes.shape[1]) < lens[:, None]] = flat
        return codes, lens

    def _forward(self, codes: np.ndarray, lens: np.ndarray, edges: list | None = None) -> np.ndarray:
        n, width = codes.shape
        alpha = np.full((n, width + 1), -np.inf)
        alpha[:, 0] = 0.0
        everyone = np.arange(n)
        for i in range(width):
            rows = everyone[lens > i]
            state = np.zeros(len(rows), np.int64)
            for j in range(i + 1, min(width, i + self.depth) + 1):
                if j > i + 1:
                    inside = lens[rows] >= j
                    rows, state = rows[inside], state[inside]
                if not len(rows):
                    break
                key = state << SHIFT | codes[rows, j - 1]
                pos = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                found = self.keys[pos] == key
                to = np.where(found, self.next[pos], 0)
                piece = np.where(found, self.end[to], -1)
                if j == i + 1 and (piece < 0).any():
                    bare = rows[piece < 0]
                    cost = self._byte_cost(codes[bare, i])
                    alpha[bare, j] = np.logaddexp(alpha[bare, j], alpha[bare, i] + cost)
                    if edges is not None:
                        edges.append((i, j, bare, None, cost))
                some = piece >= 0
                at, p = rows[some], piece[some]
                alpha[at, j] = np.logaddexp(alpha[at, j], alpha[at, i] + self.log_p[p])
                if edges is not None and len(at):
                    edges.append((i, j, at, p, self.log_p[p]))
                rows, state = rows[found], to[found]
        return alpha

    def _one(self, word: str) -> float:
        """The same recursion for one long word, in a ring of ``depth`` cells."""
        size = self.depth + 1
        ring = [-math.inf] * size
        ring[0] = 0.0
        for i in range(len(word)):
            a, state = ring[i % size], 0
            ring[i % size] = -math.inf
            for j in range(i, min(len(word), i + self.depth)):
                state = self.children.get(state << SHIFT | ord(word[j]))
                p = None if state is None else self.ends.get(state)
                if p is not None or j == i:
                    w = a + (float(self.log_p[p]) if p is not None else float(self._byte_cost(np.array(ord(word[i])))))
                    cell = (j + 1) % size
                    b = ring[cell]
                    hi, lo = (w, b) if w > b else (b, w)
                    ring[cell] = hi if lo == -math.inf else hi + math.log1p(math.exp(lo - hi))
                if state is None:
                    break
        return ring[len(word) % size]

    def score(self, words: list[str]) -> np.ndarray:
        """Natural log of each word's probability."""
        out = np.zeros(len(words))
        lens = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lens, kind="stable")
        short = order[lens[order] <= LONG]
        for at in range(0, len(short), BATCH):
            pick = short[at:at + BATCH]
            codes, n = self._matrix([words[k] for k in pick])
            alpha = self._forward(codes, n)
            out[pick] = alpha[np.arange(len(pick)), n]
        for k in order[lens[order] > LONG]:
            out[k] = self._one(words[k])
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, every word as a whole."""
        weight = np.asarray(counts, float)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lens, kind="stable")
        short = order[lens[order] <= LONG]
        total = np.zeros(len(self.log_p))
        for at in range(0, len(short), BATCH):
            pick = short[at:at + BATCH]
            codes, n = self._matrix([words[k] for k in pick])
            edges: list = []
            alpha = self._forward(codes, n, edges)
            rows = np.arange(len(pick))
            all_ = alpha[rows, n]
            beta = np.full(alpha.shape, -np.inf)
            beta[rows, n] = 0.0
            for i, j, r, p, w in sorted(edges, key=lambda e: -e[1]):
                tail = beta[r, j] + w
                beta[r, i] = np.logaddexp(beta[r, i], tail)
                if p is not None:
                    share = np.exp(alpha[r, i] + tail - all_[r]) * weight[pick][r]
                    total += np.bincount(p, share, len(total))
        for k in order[lens[order] > LONG]:
            self._expected_one(words[k], float(weight[k]), total)
        return total

    def _walk(self, word: str, i: int) -> Iterator[tuple[int, int | None, float]]:
        """``(j, piece, log p)`` of the pieces that begin at ``i``; bytes (no piece) if no piece is the one character."""
        state = 0
        for j in range(i, min(len(word), i + self.depth)):
            state = self.children.get(state << SHIFT | ord(word[j]))
            p = None if state is None else self.ends.get(state)
            if p is not None:
                yield j + 1, p, self.logs[p]
            elif j == i:
                yield j + 1, None, self.log_byte * len(word[i].encode("utf-8", "surrogatepass"))
            if state is None:
                return

    def _expected_one(self, word: str, weight: float, total: np.ndarray) -> None:
        """Forward over the whole word, then backward: two numbers per character, no list of edges."""
        n = len(word)
        alpha, beta = array("d", [-math.inf]) * (n + 1), array("d", [-math.inf]) * (n + 1)
        alpha[0] = beta[n] = 0.0
        for i in range(n):
            for j, _, w in self._walk(word, i):
                alpha[j] = _log_add(alpha[j], alpha[i] + w)
        for i in range(n - 1, -1, -1):
            for j, p, w in self._walk(word, i):
                tail = beta[j] + w
                beta[i] = _log_add(beta[i], tail)
                if p is not None:
                    total[p] += weight * math.exp(alpha[i] + tail - alpha[n])


def _log_add(a: float, b: float) -> float:
    hi, lo = (a, b) if a > b else (b, a)
    return hi if lo == -math.inf else hi + math.log1p(math.exp(lo - hi))


def prior(scores: list[float]) -> np.ndarray:
    """Probabilities of pieces whose scores are negative ranks: Zipf's law."""
    weight = 1.0 / (np.maximum(-np.asarray(scores, float), 0.0) + 2.7)
    return weight / weight.sum()


def load_pieces(path: str) -> tuple[list[str], list[float]]:
    """Pieces and scores of a vocabulary file; bytes, control and unused pieces
    have no text here and their own place at the end of the scores."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, scores = [], []
    for i in range(len(sp)):
        if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) and sp.get_score(i) > -1e8:
            pieces.append(sp.id_to_piece(i))
            scores.append(sp.get_score(i))
    return pieces, scores
