"""H1 without a sort: epochs over numbered rows, in an order that is a formula.

A training table is numbered once (``ordinal.order_rank`` or ``add_position``).  Each
epoch's order is then a column, and a range of ranks - a batch, a shard, what is
left after a restart - is a predicate: nothing is sorted, shuffled or written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogprep.functions.permutation import Permutation


def epoch_order(df: DataFrame, n: int, position: str = "pos", seed: int | str = 42, epoch: int = 0, rank_col: str = "shuffle_rank") -> DataFrame:
    """Adds each row's 0-based rank in the epoch's order; ``position`` numbers the ``n`` rows from 0.

    A position that is null or not below ``n`` fails the job.
    """
    return df.withColumn(rank_col, Permutation(n, seed, epoch).rank(F.col(position)))


def epoch_rows(df: DataFrame, n: int, start: int, stop: int | None = None, position: str = "pos", seed: int | str = 42, epoch: int = 0,
               rank_col: str = "shuffle_rank") -> DataFrame:
    """The rows of ranks ``start <= rank < stop`` of an epoch: where a run goes on in the middle of it."""
    ranked = epoch_order(df, n, position, seed, epoch, rank_col)
    keep = F.col(rank_col) >= start
    return ranked.filter(keep if stop is None else keep & (F.col(rank_col) < stop))
