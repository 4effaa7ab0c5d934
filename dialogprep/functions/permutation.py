"""A shuffled order that is a formula: a keyed permutation of 0 .. n-1.

A position is written as two digits ``left * b + right`` with ``left < a`` and
``right < b``; every round adds a mix of one digit and a key to the other one, so
it can be undone, and the rounds together are a permutation of 0 .. a*b-1 (a
Feistel network on mixed digits).  What falls on n or beyond is put through again
until it does not (cycle walking): that is a permutation of 0 .. n-1.  a and b are
chosen so that a*b is barely above n, and the walk is as long as that excess at
most, so a row costs the same at any n.

The rank of a row and the row of a rank need nothing but the number itself: no
sort, no shuffle, no table.  Another epoch is another key.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 8
CANDIDATES = 64  # widths tried for a
# The mix is FACTOR * v^2 + v modulo PRIME, which is 2^31 - 1.
PRIME, FACTOR = 2147483647, 1103515245


class Permutation:
    """A permutation of 0 .. n-1 for a seed and an epoch."""

    def __init__(self, n: int, seed: int | str = 42, epoch: int = 0):
        if not 1 <= n <= 1 << 60:
            raise ValueError(f"cannot permute {n} positions")
        self.n = n
        root = math.isqrt(n - 1) + 1
        self.a = min(range(root, root + min(root, CANDIDATES)), key=lambda a: (a * -(-n // a) - n, a))
        self.b = -(-n // self.a)
        self.keys = [int(hashlib.md5(f"permute|{seed}|{epoch}|{r}".encode()).hexdigest()[:7], 16) for r in range(ROUNDS)]

    def rank(self, position: Column) -> Column:
        """The place of a row in the shuffled order."""
        return self._walk(position.cast("long"), self._forward)

    def position(self, rank: Column) -> Column:
        """The row that has a place in the shuffled order."""
        return self._walk(rank.cast("long"), self._backward)

    def _walk(self, x: Column, once) -> Column:
        """``once`` until the result is below n; what needs more than one turn is rare."""
        valid = (x >= 0) & (x < self.n)
        out = F.when(valid, once(x)).otherwise(F.raise_error(F.concat(F.lit(f"not a position below {self.n}: "), F.coalesce(x.cast("string"), F.lit("null")))).cast("long"))
        more = self.a * self.b - self.n
        if not more:
            return out
        # Values that a walk can meet on its way are the excess ones, each once.
        turns = F.sequence(F.lit(1), F.lit(more))
        return F.transform(F.array(out), lambda y: F.when(y < self.n, y).otherwise(
            F.aggregate(turns, y, lambda z, _: F.when(z < self.n, z).otherwise(once(z)))))[0]

    def _mixed(self, digit: Column, key: Column) -> Column:
        v = F.pmod(digit + key, F.lit(PRIME))
        return F.pmod(F.pmod(v * v, F.lit(PRIME)) * FACTOR + v, F.lit(PRIME))

    def _forward(self, x: Column) -> Column:
        return self._rounds(x, list(enumerate(self.keys)), 1)

    def _backward(self, x: Column) -> Column:
        return self._rounds(x, list(enumerate(self.keys))[::-1], -1)

    def _rounds(self, x: Column, rounds: list[tuple[int, int]], sign: int) -> Column:
        # One array of the two digits that goes through the rounds, so that no expression is written out twice.
        right = F.pmod(x, F.lit(self.b))
        digits = F.array(F.call_function("div", x, F.lit(self.b)), right).cast("array<bigint>")
        steps = F.array(*[F.struct(F.lit(r % 2).alias("side"), F.lit(k).cast("long").alias("key")) for r, k in rounds])

        def turn(d: Column, s: Column) -> Column:
            other = F.when(s["side"] == 0, d[1]).otherwise(d[0])
            mix = self._mixed(other, s["key"]) * sign
            return F.when(s["side"] == 0, F.array(F.pmod(d[0] + mix, F.lit(self.a).cast("long")), d[1])).otherwise(F.array(d[0], F.pmod(d[1] + mix, F.lit(self.b).cast("long"))))

        return F.aggregate(steps, digits, turn, lambda d: d[0] * F.lit(self.b) + d[1])
