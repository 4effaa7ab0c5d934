"""Hard-negative mining by segment summaries.

Every vector is cut into segments, and of each segment the mean and the deviation
(the norm of what is left after the mean) are stored, for ``LEVELS`` segment
counts, coarse to fine.  Over a segment of length m the inner product of x and y
is m * mean(x) * mean(y) plus the product of the rests, and that is between minus
and plus the product of the deviations.  So the means' product plus or minus the
deviations' product, summed over segments, bounds the score:

1. the bounds of the coarsest level rule out vectors that no anchor of a block
   can use; the next level looks at what is left, and so on;
2. what is left then is scored exactly.

Two passes: the best same-label rows of each anchor (blocks are sorted by label, so
only blocks that hold an anchor block's labels are read), then, per anchor and
positive, the best other-label rows in the band [``low`` %, ``high`` %] of the
positive's score.  In both the hits so far narrow what a bound must reach.  Anchors
meet the rows as blocks of bounded bytes, a label's rows spread over as many
blocks as they fill; no task or driver holds a label, and all rows are judged.

Defined results: components x become floor(256 * x); rows with a null label, a null
vector or any null or non-finite component take no part; shorter vectors count as
padded with zeros (an empty one scores 0); positives are other rows, so a row
that repeats an anchor is one; ties go to the smaller id, null last; repeated
anchor rows give repeated results; a band with no row gives none (a negative
positive score has an empty band); an empty table gives none; inner products of
2^56 or more fail the job; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialogprep.llm import blocks as B
from dialogprep.llm.common import keep

LEVELS = (4, 16)  # segments of a vector, coarse to fine
SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def segments(dim: int) -> list[np.ndarray]:
    """Borders of the segments of each level (a level finer than the vector is left out)."""
    return [np.linspace(0, dim, n + 1).astype(int) for n in LEVELS if n < dim]


def summarise(v: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level: means scaled by the root of the segment's length, and deviations."""
    x = v.astype(np.float64)
    out = []
    for cut in segments(v.shape[1]):
        size = np.diff(cut)
        mean = np.add.reduceat(x, cut[:-1], axis=1) / size
        rest = x - np.repeat(mean, size, axis=1)
        out.append((mean * np.sqrt(size), np.sqrt(np.add.reduceat(rest * rest, cut[:-1], axis=1))))
    return out


def stored(v: np.ndarray) -> bytes:
    """The summaries as 32-bit numbers; :func:`slack` covers their rounding."""
    return b"".join(np.concatenate(level, axis=1).astype("<f4").tobytes() for level in summarise(v))


def load(raw: bytes, n: int, dim: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    flat = np.frombuffer(raw, "<f4")
    for cut in segments(dim):
        w = 2 * (len(cut) - 1)
        level = flat[at:at + n * w].reshape(n, w).astype(np.float64)
        out.append((level[:, :w // 2], level[:, w // 2:]))
        at += n * w
    return out


def slack(norm2: float) -> float:
    """More than the rounding of a bound: a share of the largest possible score."""
    return 1.0 + 1e-5 * norm2


class _Anchors:
    """An anchor block in a task."""

    def __init__(self, row: dict, shape: B.Shape):
        self.ids, _ = B.ids_of(row)
        self.labels, self.homes, self.places = (row[c].values.to_numpy() for c in ("labels", "homes", "places"))
        self.shape = shape
        self.v = B.unpack(row["v"].as_py(), len(self.ids), shape.dim, shape.dtype)
        self.levels = summarise(self.v)
        self.slack = slack(shape.norm2)

    def near(self, row: dict, need, label_fits) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Tiles (anchors, columns, scores, fitting cells) of what the bounds leave.

        ``need(anchors)``: least and largest score that each can use now.
        """
        n = len(row["ids"].values)
        labels = row["labels"].values.to_numpy()
        v = B.unpack(row["v"].as_py(), n, self.shape.dim, self.shape.dtype)
        summary = load(row["extra"].as_py(), n, self.shape.dim)
        block = row["block"].as_py()
        for a in range(0, len(self.ids), B.TILE):
            mine = np.arange(a, min(a + B.TILE, len(self.ids)))
            lo, hi = need(mine)
            fits = label_fits(self.labels[mine][:, None], labels)
            own = np.flatnonzero(self.homes[mine] == block)
            fits[own, self.places[mine[own]]] = False
            fits &= (lo <= hi)[:, None]
            live = np.flatnonzero(fits.any(axis=0))
            for (am, ad), (cm, cd) in zip(self.levels, summary, strict=True):
                if not len(live):
                    break
                mid, off = am[mine] @ cm[live].T, ad[mine] @ cd[live].T + self.slack
                fits[:, live] &= (mid + off >= lo[:, None]) & (mid - off <= hi[:, None])
                live = live[fits[:, live].any(axis=0)]
            if len(live):
                yield mine, live, B.scores(self.v[mine], v[live], self.shape.exact), fits[:, live]


def _number(x: np.ndarray) -> np.ndarray:
    """Thresholds as floating-point numbers for bounds (those have slack)."""
    return np.where(x == np.iinfo(np.int64).min, -np.inf, x.astype(np.float64))


def positives(anchors: DataFrame, pairs: DataFrame, blocks: DataFrame, shape: B.Shape, n_pos: int, slices: int) -> DataFrame:
    """``q, at, home, place, score, id, nth``: the best same-label rows of each anchor."""

    def visit(head: dict, its: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        an, best = _Anchors(head, shape), B.Best(len(head["ids"].values), n_pos)
        for row in its:
            ids, null = B.ids_of(row)
            for mine, live, s, fits in an.near(row, lambda m: (_number(best.least[m]), np.full(len(m), np.inf)), np.equal):
                i, j = B.cells(s, fits & (s >= best.least[mine].astype(s.dtype)[:, None]), n_pos)
                best.add(mine[i], s[i, j], ids[live[j]], null[live[j]])
        yield pa.record_batch({"q": np.full(len(best.owner), head["q"].as_py(), np.int64), "at": best.owner.astype(np.int32), "score": best.score, "id": pa.array(best.id, mask=best.null)})

    found = B.meet(anchors, pairs, blocks, slices, visit, "q long, at int, score long, id long")
    by = Window.partitionBy("q", "at").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("nth", F.row_number().over(by)).filter(F.col("nth") <= n_pos)


def mine(df: DataFrame, anchor: Column, label: Column, n_pos: int = 5, n_neg: int = 5, low: int = 80, high: int = 100,
         id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Hard negatives (:data:`SCHEMA`) for every row where ``anchor`` holds and each of its positives."""
    spark = df.sparkSession
    rows = B.integer_vectors(df, id_col, vector_col, label, anchor)
    shape = B.Shape(rows)
    if not shape.queries:
        return spark.createDataFrame([], SCHEMA)
    rows = rows.withColumn("key", F.col("label").cast("double"))
    blocks = B.pack(rows, ["label", "id"], shape, B.BLOCK_BYTES, shape.rows, stored)
    anchors = B.pack(B.query_rows(blocks, shape).withColumn("key", F.col("label").cast("double")), ["home", "place"], shape, B.QUERY_BYTES, shape.queries)
    n_blocks, n_anchors = blocks.count(), anchors.count()
    slices = B.slices_for(n_blocks, n_anchors, spark.sparkContext.defaultParallelism)
    # One narrow row per (anchor block, block): every block takes the numbered anchor blocks.
    numbered = anchors.select(F.col("block").alias("q"), F.col("lo").alias("l0"), F.col("hi").alias("h0"), (F.row_number().over(Window.orderBy("block")) - 1).alias("i"))
    pairs = blocks.select("block", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(n_anchors - 1))).alias("i")).join(numbered, "i")
    pairs = keep(pairs.select("q", "block", F.lit(0.0).alias("ord"), ((F.col("lo") <= F.col("h0")) & (F.col("hi") >= F.col("l0"))).alias("same")))

    pos = keep(positives(anchors, pairs.filter("same").drop("same"), blocks, shape, n_pos, slices))
    # A block's positives: its bounded number of anchors times n_pos.
    state = pos.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("at", "nth", "score"))).alias("p"))
    state = state.select(F.col("q").alias("block"), F.to_json(F.struct(F.col("p.at").alias("at"), F.col("p.nth").alias("nth"), F.col("p.score").alias("score"))).cast("binary").alias("state"))
    armed = anchors.join(state, "block")  # blocks without a positive have no result

    def visit(head: dict, its: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        import json

        an, got = _Anchors(head, shape), json.loads(head["state"].as_py())
        n = len(an.ids)
        score = np.zeros((n, n_pos), np.int64)
        has = np.zeros((n, n_pos), bool)
        at, nth = np.array(got["at"]), np.array(got["nth"]) - 1
        score[at, nth], has[at, nth] = got["score"], True
        top = np.where(has, high * score // 100, np.iinfo(np.int64).min)  # largest integer within high %
        floor = np.where(has, -(-low * score // 100), np.iinfo(np.int64).max)  # least within low %
        best = B.Best(n * n_pos, n_neg)

        def least(m: np.ndarray) -> np.ndarray:
            return np.maximum(floor[m], best.least.reshape(n, n_pos)[m])

        def need(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            open_ = least(m) <= top[m]
            return (np.where(open_, least(m).astype(np.float64), np.inf).min(axis=1), np.where(open_, top[m].astype(np.float64), -np.inf).max(axis=1))

        for row in its:
            ids, null = B.ids_of(row)
            for m, live, s, fits in an.near(row, need, np.not_equal):
                for j in range(n_pos):
                    r = np.flatnonzero(least(m)[:, j] <= top[m, j])
                    if not len(r):
                        continue
                    sr = s[r]
                    i, c = B.cells(sr, fits[r] & (sr >= least(m)[r, j][:, None]) & (sr <= top[m[r], j][:, None]), n_neg)
                    best.add(m[r[i]] * n_pos + j, sr[i, c], ids[live[c]], null[live[c]])
        own = best.owner // n_pos
        yield pa.record_batch({"q": np.full(len(own), head["q"].as_py(), np.int64), "at": own.astype(np.int32), "nth": (best.owner % n_pos + 1).astype(np.int32),
                               "anchor_id": an.ids[own], "negative_score": best.score, "negative_id": pa.array(best.id, mask=best.null)})

    found = B.meet(armed, pairs.drop("same"), blocks, slices, visit, "q long, at int, nth int, anchor_id long, negative_score long, negative_id long")
    by = Window.partitionBy("q", "at", "nth").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    found = found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= n_neg)
    out = found.join(pos.withColumnsRenamed({"id": "positive_id", "score": "positive_score"}), ["q", "at", "nth"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
