"""Exact top-k search by inner product: a pivot-distance index.

1. Space: with M the largest norm, a vector x becomes (x, sqrt(M^2 - |x|^2)) and
   a query q becomes (q, 0).  Then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the
   largest inner products are the nearest vectors, and the triangle inequality
   holds.
2. Index: ``PIVOTS`` points fitted on at most ``SAMPLE`` rows.  Every vector is
   keyed by its nearest pivot and the distance to it; the keys are sorted, and
   the sorted rows are cut into blocks of bounded bytes: the annuli of a pivot.
3. Search: a vector of an annulus [lo, hi] of pivot p is at least
   max(lo - d(q, p), d(q, p) - hi) away from q.  Annuli are expanded in the order
   of this bound, ``FIRST`` of them to begin with, then all that the distance of
   the k-th hit so far does not rule out; inside a task the hits go on ruling
   out annuli and queries.  Bounds are widened by more than rounding, and equal
   ones are visited, so ties are complete.

The search is exact whatever the pivots: a poor sample costs time only.  The plan
joins, per pivot, the annuli with the range of distances that a query block can
still use; vectors move as blocks (:mod:`dialogprep.llm.blocks`).  A third of all rows
on one vector is one annulus of many blocks.

Defined results: components x become floor(256 * x); vectors that are null or hold
a null or non-finite component take no part, as query or candidate; shorter
vectors count as padded with zeros (an empty one scores 0); a query meets every
row but itself, so another row with its id is a candidate; ties go to the smaller
id, null last; repeated query rows give repeated results; fewer candidates than k
give fewer rows; an empty table none; inner products of 2^56 or more fail the
job; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialogprep.llm import blocks as B
from dialogprep.llm.common import keep

PIVOTS = 64
SAMPLE = 4096  # rows that the pivots are fitted on
ROUNDS = 5  # of the fit
FIRST = 8  # annuli that a query block expands before the rest is planned

HITS = "home long, place int, query_id long, score long, id long"


def lift(v: np.ndarray, norm2: float) -> np.ndarray:
    """Vectors on the sphere of radius M."""
    v = v.astype(np.float64)
    return np.c_[v, np.sqrt(np.maximum(norm2 - (v * v).sum(1), 0.0))]


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d2 = (points * points).sum(1)[:, None] + (pivots * pivots).sum(1) - 2.0 * points @ pivots.T
    return np.sqrt(np.maximum(d2, 0.0))


def slack(norm2: float) -> float:
    """More than the rounding of a distance computed through squares."""
    return 1e-6 * (1.0 + norm2 ** 0.5)


def fit_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Centres of the sample's clusters, from evenly spread rows of it."""
    centres = sample[np.linspace(0, len(sample) - 1, min(n, len(sample))).astype(int)]
    for _ in range(ROUNDS):
        near = distances(sample, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        count = np.bincount(near, minlength=len(centres))
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return np.unique(centres, axis=0)


def index(rows: DataFrame, shape: B.Shape, pivots: np.ndarray) -> DataFrame:
    """The annuli: blocks of rows of one pivot, sorted by distance."""
    dim, norm2 = shape.dim, shape.norm2

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = distances(lift(B.matrix(b.column("v"), dim, "<f8"), norm2), pivots)
            near = d.argmin(1)
            yield pa.record_batch([*b.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(near)), near])], names=[*b.schema.names, "part", "key"])

    placed = rows.mapInArrow(place, "id long, label long, asked boolean, v array<double>, part int, key double")
    return B.pack(placed, ["part", "key", "id"], shape, B.BLOCK_BYTES, shape.rows)


class _Queries:
    """A query block in a task: its vectors, distances to the pivots, and hits so far."""

    def __init__(self, row: dict, shape: B.Shape, pivots: np.ndarray, k: int):
        self.ids, _ = B.ids_of(row)
        self.homes, self.places = (row[c].values.to_numpy() for c in ("homes", "places"))
        self.v = B.unpack(row["v"].as_py(), len(self.ids), shape.dim, shape.dtype)
        self.norm2 = (self.v.astype(np.float64) ** 2).sum(1)
        self.to_pivot = distances(np.c_[self.v.astype(np.float64), np.zeros(len(self.ids))], pivots)
        self.best = B.Best(len(self.ids), k)
        self.shape = shape
        if row["state"].is_valid:
            got = pa.ipc.open_stream(row["state"].as_py()).read_all()
            self.best.add(*(got.column(c).to_numpy() for c in ("owner", "score", "id")), got.column("null").to_numpy().astype(bool), new=False)

    def radius(self) -> np.ndarray:
        """Distance within which every further hit lies."""
        least = np.where(self.best.least == np.iinfo(np.int64).min, -np.inf, self.best.least.astype(np.float64))
        return np.sqrt(np.maximum(self.norm2 + self.shape.norm2 - 2.0 * least, 0.0)) + slack(self.shape.norm2)

    def visit(self, row: dict) -> None:
        p, lo, hi = (row[c].as_py() for c in ("part", "lo", "hi"))
        d = self.to_pivot[:, p]
        open_ = np.flatnonzero(np.maximum(lo - d, d - hi) <= self.radius())
        if not len(open_):
            return
        ids, null = B.ids_of(row)
        v = B.unpack(row["v"].as_py(), len(ids), self.shape.dim, self.shape.dtype)
        block, k = row["block"].as_py(), self.best.k
        for a in range(0, len(open_), B.TILE):
            mine = open_[a:a + B.TILE]
            s = B.scores(self.v[mine], v, self.shape.exact)
            own = np.flatnonzero(self.homes[mine] == block)
            floor = np.iinfo(np.int64).min if s.dtype == np.int64 else -np.inf
            s[own, self.places[mine[own]]] = floor
            q, c = B.cells(s, (s >= self.best.least[mine].astype(s.dtype)[:, None]) & (s > floor), k)
            self.best.add(mine[q], s[q, c], ids[c], null[c])

    def state(self) -> bytes:
        b = self.best
        t = pa.record_batch({"owner": b.owner, "score": b.score, "id": b.id, "null": b.null})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema) as w:
            w.write_batch(t)
        return sink.getvalue().to_pybytes()

    def hits(self, with_old: bool) -> pa.RecordBatch:
        b = self.best
        at = b.new | with_old
        own = b.owner[at]
        return pa.record_batch({"home": self.homes[own], "place": self.places[own], "query_id": self.ids[own], "score": b.score[at],
                                "id": pa.array(b.id[at], mask=b.null[at])})


def reach(queries: DataFrame, shape: B.Shape, pivots: np.ndarray, k: int) -> DataFrame:
    """Per query block and pivot: least and largest distance, and the range of distances that can hold hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i] for c in b.schema.names}
                at = _Queries(row, shape, pivots, k)
                d, r = at.to_pivot, at.radius()[:, None]
                n = len(pivots)
                yield pa.record_batch({"q": np.full(n, row["block"].as_py()), "part": np.arange(n, dtype=np.int32), "near": d.min(0), "far": d.max(0),
                                       "from": (d - r).min(0), "to": (d + r).max(0)})

    return queries.select("block", "ids", "homes", "places", "v", "state").mapInArrow(run, "q long, part int, near double, far double, from double, to double")


def plan(queries: DataFrame, annuli: DataFrame, shape: B.Shape, pivots: np.ndarray, k: int) -> DataFrame:
    """The (query block, annulus) pairs that can hold hits, ``ord`` = lower bound of their distance."""
    ring = annuli.select("block", "part", "lo", "hi")
    r = reach(queries, shape, pivots, k)
    pairs = r.join(ring, "part").filter((F.col("hi") >= F.col("from")) & (F.col("lo") <= F.col("to")))
    return pairs.select("q", "block", F.greatest(F.lit(0.0), F.col("lo") - F.col("far"), F.col("near") - F.col("hi")).alias("ord"))


def top_k(df: DataFrame, asked: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, id, score``: the ``k`` best rows for every row where ``asked``."""
    spark = df.sparkSession
    rows = B.integer_vectors(df, id_col, vector_col, None, asked)
    shape = B.Shape(rows)
    if not shape.queries:
        return spark.createDataFrame([], "query_id long, rank int, id long, score long")
    drawn = rows.select("v", F.xxhash64("id", "v").alias("_h")).orderBy("_h", "v").limit(SAMPLE).select("v").toArrow()
    pivots = fit_pivots(lift(B.matrix(drawn.column("v").combine_chunks(), shape.dim, "<f8"), shape.norm2))
    annuli = index(rows, shape, pivots)
    queries = B.pack(B.query_rows(annuli, shape), ["home", "place"], shape, B.QUERY_BYTES, shape.queries).withColumn("state", F.lit(None).cast("binary"))
    n_annuli, n_queries = annuli.count(), queries.count()
    slices = B.slices_for(n_annuli, n_queries, spark.sparkContext.defaultParallelism)

    def expand(head: dict, its: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        at = _Queries(head, shape, pivots, k)
        for row in its:
            at.visit(row)
        kept = {"block": head["q"], "ids": head["ids"], "homes": head["homes"], "places": head["places"], "v": head["v"], "state": pa.scalar(at.state())}
        yield pa.record_batch({c: pa.array([x.as_py()], x.type) for c, x in kept.items()})

    near = Window.partitionBy("q").orderBy("ord", "block")
    first = keep(plan(queries, annuli, shape, pivots, k).withColumn("_n", F.row_number().over(near)).filter(F.col("_n") <= FIRST).drop("_n"))
    begun = keep(B.meet(queries, first, annuli, 1, expand, "block long, ids array<bigint>, homes array<bigint>, places array<int>, v binary, state binary"))

    def finish(head: dict, its: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        at = _Queries(head, shape, pivots, k)
        for row in its:
            at.visit(row)
        yield at.hits(head["slice"].as_py() == 0)  # of the slices one carries the first hits on

    rest = plan(begun, annuli, shape, pivots, k).join(first.select("q", "block"), ["q", "block"], "left_anti")
    found = B.meet(begun, rest, annuli, slices, finish, HITS)
    best = Window.partitionBy("home", "place").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")
