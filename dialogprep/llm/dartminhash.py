"""DartMinHash signatures of weighted sets, a batch of texts at a time.

Every element owns a strip of the plane: weight on one axis, rank on the other.
Hashing the element throws darts into the strip, the same ones in every text:
per unit of weight a Poisson process of unit rate along the rank axis.  A text
sees the darts below its element's weight and below a rank limit that gives it
about ``k ln k + 2 k`` darts in all, so the work does not grow with ``k`` times
the number of elements.  Each dart falls on one of ``k`` coordinates, and the
earliest dart of a coordinate is its value.  Two texts agree on a coordinate
with probability sum(min) / sum(max) of their weights, the weighted Jaccard
similarity; with all weights 1 that is the Jaccard similarity of the sets.

A text with an empty coordinate gets its rank limit doubled until all are hit.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash

WORDS_PER_SHINGLE = 5
CACHE_WORDS = 1 << 19
STEEP = 32.0  # above this rank limit a text is done by itself

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_COLUMN, _DART, _Y = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) / 9007199254740992.0


class WordHash(dict):
    """64-bit hashes of words, with a cache of bounded size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(words: list[bytes], hashes: WordHash) -> np.ndarray:
    """Hashes of each five words in a row; a shorter text is one shingle, an empty one none."""
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(WORDS_PER_SHINGLE, len(h))
    if not n:
        return h
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix(out * _GOLD + h[i:len(h) - n + 1 + i])
    return out


def _strips(sets: list[tuple[np.ndarray, np.ndarray]]):
    """One strip per element and unit of weight: text, seed, part of the unit that counts."""
    text = np.repeat(np.arange(len(sets)), [len(e) for e, _ in sets])
    element = np.concatenate([e for e, _ in sets])
    weight = np.concatenate([w for _, w in sets]).astype(np.float64)
    units = np.ceil(weight).astype(np.int64)
    pick = np.repeat(np.arange(len(element)), units)
    column = np.arange(len(pick)) - np.repeat(np.cumsum(units) - units, units)
    seed = mix(element[pick] + column.astype(np.uint64) * _COLUMN)
    return text[pick], seed, np.minimum(weight[pick] - column, 1.0)


def _throw(text, seed, part, limit, n_texts, k):
    """Values of the earliest darts, and which coordinates were hit."""
    texts, darts, ranks = [], [], []
    rank, step = np.zeros(len(seed)), 0
    while len(seed):
        step += 1
        h = mix(seed + np.array([step], np.uint64) * _GOLD)
        rank = rank - np.log(_uniform(h))
        alive = rank < limit
        text, seed, part, limit, rank, h = (a[alive] for a in (text, seed, part, limit, rank, h))
        below = _uniform(mix(h ^ _Y)) <= part
        texts.append(text[below])
        darts.append(mix(h ^ _DART)[below])
        ranks.append(rank[below])
    return _earliest(np.concatenate(texts or [np.zeros(0, np.int64)]), np.concatenate(darts or [np.zeros(0, np.uint64)]),
                     np.concatenate(ranks or [np.zeros(0)]), n_texts, k)


def _throw_few(seed, part, limit, k):
    """The same for one text of small weight, all steps at once."""
    steps = int(limit + 6 * math.sqrt(limit) + 12)
    while True:
        h = mix(seed[:, None] + np.arange(1, steps + 1, dtype=np.uint64) * _GOLD)
        rank = np.cumsum(-np.log(_uniform(h)), axis=1)
        if (rank[:, -1] >= limit).all():
            break
        steps *= 2
    see = (rank < limit) & (_uniform(mix(h ^ _Y)) <= part[:, None])
    return _earliest(np.zeros(int(see.sum()), np.int64), mix(h[see] ^ _DART), rank[see], 1, k)


def _earliest(text, dart, rank, n_texts, k):
    out = np.zeros(n_texts * k, np.uint64)
    hit = np.zeros(n_texts * k, bool)
    order = np.argsort(-rank, kind="stable")  # the earliest is written last
    cell = (text * k + (dart % np.uint64(k)).astype(np.int64))[order]
    out[cell] = dart[order]
    hit[cell] = True
    return out.reshape(n_texts, k), hit.reshape(n_texts, k)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """``k`` values for each (elements, weights); zeros for an empty set."""
    out = np.zeros((len(sets), k), np.uint64)
    weight = np.array([float(w.sum()) for _, w in sets])
    darts = k * math.log(k) + 2 * k
    limits = np.divide(darts, weight, out=np.zeros(len(sets)), where=weight > 0)
    todo = np.flatnonzero(weight > 0)
    while len(todo):
        again = []
        many = todo[limits[todo] <= STEEP]
        if len(many):
            text, seed, part = _strips([sets[i] for i in many])
            got, hit = _throw(text, seed, part, limits[many][text], len(many), k)
            full = hit.all(axis=1)
            out[many[full]] = got[full]
            again += list(many[~full])
        for i in todo[limits[todo] > STEEP]:
            _, seed, part = _strips([sets[i]])
            got, hit = _throw_few(seed, part, limits[i], k)
            if hit.all():
                out[i] = got[0]
            else:
                again.append(i)
        todo = np.array(again, np.int64)
        limits[todo] *= 2
    return out
