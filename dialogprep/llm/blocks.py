"""Vectors in packed blocks, and blocks of queries that meet them.

A search of many queries against many vectors moves blocks, not rows: sorted
rows are packed into blocks of bounded bytes, a plan names the (query block,
block) pairs worth a visit, and a task takes a query block and reads its blocks
one after the other in the plan's order.  So a task holds one query block, one
block and the best hits so far, whatever the table's size, and a hot group is
cut by bytes like any other.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogprep.llm.common import keep

BLOCK_BYTES = 1 << 20  # of the vectors of a block
QUERY_BYTES = 1 << 18  # of the vectors of a query block
TILE = 256  # queries scored at once
SCORE_LIMIT = 1 << 56  # scores beyond do not leave room for their percentages

PACKED = "block long, ids array<bigint>, labels array<bigint>, homes array<bigint>, places array<int>, asked array<boolean>, v binary, extra binary, part int, lo double, hi double"
_ARROW = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("homes", pa.list_(pa.int64())),
                    ("places", pa.list_(pa.int32())), ("asked", pa.list_(pa.bool_())), ("v", pa.binary()), ("extra", pa.binary()),
                    ("part", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64())])


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, label: Column | None, asked: Column) -> DataFrame:
    """``id, label, asked, v``: each component x as floor(256 * x); rows that take no part are left out."""
    raw = df[f"`{vector_col}`"].cast("array<double>")
    bad = F.exists(raw, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    lab = (label if label is not None else F.lit(0)).cast("long")
    rows = df.select(df[f"`{id_col}`"].cast("long").alias("id"), lab.alias("label"), F.coalesce(asked, F.lit(False)).alias("asked"), raw.alias("raw"), bad.alias("bad"))
    rows = rows.filter(F.col("raw").isNotNull() & ~F.coalesce("bad", F.lit(False)) & F.col("label").isNotNull())
    # A product with a power of two is exact, so floor is that of the real number.
    return rows.select("id", "label", "asked", F.transform("raw", lambda x: F.floor(x * 256.0).cast("double")).alias("v"))


class Shape:
    """Size of a table of vectors: rows, queries, components, largest norm and component."""

    def __init__(self, rows: DataFrame):
        norm = F.aggregate("v", F.lit(0.0), lambda z, x: z + x * x)
        top = F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0.0))
        got = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("asked").alias("q"), F.max(F.size("v")).alias("d"), F.max(norm).alias("m"), F.max(top).alias("t")).head()
        self.rows, self.queries, self.dim = got.n, got.q, max(1, got.d or 0)
        self.norm2, top = float(got.m or 0.0), float(got.t or 0.0)
        if self.norm2 >= SCORE_LIMIT:
            raise ValueError(f"inner products up to {self.norm2:g} do not fit: the limit is 2^56")
        self.dtype = "<i2" if top < 2 ** 15 else "<i4"
        self.exact = self.norm2 * 2 < 2 ** 53  # sums of products are exact as floating-point numbers

    def per_block(self, size: int) -> int:
        return max(1, size // (np.dtype(self.dtype).itemsize * self.dim))


def matrix(column: pa.Array, dim: int, dtype: str) -> np.ndarray:
    """Rows of a list column, padded with zeros to ``dim``."""
    flat = np.asarray(column.flatten(), dtype=dtype)
    sizes = np.asarray(column.value_lengths(), dtype=np.int64)
    out = np.zeros((len(sizes), dim), dtype=dtype)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def unpack(raw: bytes, n: int, dim: int, dtype: str) -> np.ndarray:
    return np.frombuffer(raw, dtype=dtype).reshape(n, dim)


def pack(rows: DataFrame, order: list[str], shape: Shape, size: int, n_rows: int, extra: Callable[[np.ndarray], bytes] | None = None) -> DataFrame:
    """Blocks (:data:`PACKED`) of the rows in ``order``, at most ``size`` bytes of vectors each.

    ``rows``: id, label, asked, v, and optionally home, place (a query's own
    block and row), part, key.  A block holds rows of one ``part``; ``lo`` and
    ``hi`` are its least and largest ``key``.  Ranges of the order go to the
    tasks, so equal keys are cut as well.
    """
    most, dim, dtype = shape.per_block(size), shape.dim, shape.dtype
    default = {"home": F.lit(None).cast("long"), "place": F.lit(None).cast("int"), "part": F.lit(0), "key": F.lit(0.0)}
    full = rows.select("id", "label", "asked", "v", *[c if c in rows.columns else d.alias(c) for c, d in default.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        held, n_held, part = [], 0, None

        def flush() -> pa.RecordBatch:
            nonlocal held, n_held, made
            t = pa.Table.from_batches(held).combine_chunks()
            t = t.take(pa.compute.sort_indices(t, [("id", "ascending")], null_placement="at_end"))  # see cells()
            col = {c: t.column(c).combine_chunks() if t.num_rows else t.column(c) for c in t.column_names}
            v = matrix(col["v"], dim, dtype)
            keys = col["key"].to_numpy(zero_copy_only=False)
            one = {"block": (task << 32) + made, "ids": col["id"], "labels": col["label"], "homes": col["home"], "places": col["place"], "asked": col["asked"],
                   "v": v.tobytes(), "extra": extra(v) if extra else b"", "part": part, "lo": float(np.min(keys)), "hi": float(np.max(keys))}
            held, n_held, made = [], 0, made + 1
            lists = {f.name for f in _ARROW if pa.types.is_list(f.type)}
            return pa.record_batch([pa.ListArray.from_arrays(pa.array([0, len(one[f.name])], pa.int32()), one[f.name].cast(f.type.value_type)) if f.name in lists
                                    else pa.array([one[f.name]], f.type) for f in _ARROW], schema=_ARROW)

        for batch in batches:
            parts = batch.column("part").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                now = int(parts[a])
                if n_held and now != part:
                    yield flush()
                part = now
                while a < b:
                    take = min(b - a, most - n_held)
                    held.append(batch.slice(a, take))
                    n_held, a = n_held + take, a + take
                    if n_held >= most:
                        yield flush()
        if n_held:
            yield flush()

    spread = rows.sparkSession.sparkContext.defaultParallelism
    n = max(min(spread, math.ceil(n_rows / 64)), math.ceil(n_rows / (8 * most)), 1)
    return keep(full.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(run, PACKED))


def query_rows(blocks: DataFrame, shape: Shape) -> DataFrame:
    """The rows of ``blocks`` that ask, with the place they stand at."""
    dim, dtype = shape.dim, shape.dtype

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asked = np.flatnonzero(np.asarray(batch.column("asked")[i].values))
                at = pa.array(asked)
                v = unpack(batch.column("v")[i].as_py(), len(batch.column("asked")[i]), dim, dtype)[asked]
                n = len(asked)
                yield pa.record_batch({
                    "id": batch.column("ids")[i].values.take(at), "label": batch.column("labels")[i].values.take(at), "asked": pa.array(np.ones(n, bool)),
                    "home": pa.array(np.full(n, batch.column("block")[i].as_py()), pa.int64()), "place": pa.array(asked.astype(np.int32)),
                    "v": pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(v.reshape(-1).astype(np.float64)))})

    return blocks.select("block", "ids", "labels", "asked", "v").mapInArrow(run, "id long, label long, asked boolean, home long, place int, v array<double>")


VISIT = "q long, slice int, ord double, block long, ids array<bigint>, labels array<bigint>, homes array<bigint>, places array<int>, v binary, extra binary, part int, lo double, hi double, state binary"
_VISIT = [c.split()[0] for c in VISIT.split(", ")]


def meet(queries: DataFrame, pairs: DataFrame, blocks: DataFrame, slices: int, visit: Callable, schema: str) -> DataFrame:
    """Run ``visit(query block, its blocks)`` for every query block and slice.

    ``queries``: packed blocks, with a ``state`` column if they carry one;
    ``pairs``: q, block, ord.  The blocks of a pair go, by slice, to the task of
    their query block and arrive in the order of ``ord``; ``visit`` gets the
    query block's row and an iterator over the rows of its blocks, and yields
    record batches.
    """
    null = lambda c: F.lit(None).cast(dict(x.split(" ", 1) for x in VISIT.split(", "))[c]).alias(c)
    q = queries.withColumnRenamed("block", "q").withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    q = q.withColumn("ord", F.lit(-1.0)).select(*[c if c in q.columns or c == "ord" else null(c) for c in _VISIT])
    p = pairs.withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int")).join(blocks, "block")
    p = p.select(*[c if c in p.columns else null(c) for c in _VISIT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ({c: b.column(c)[i] for c in b.schema.names} for b in batches for i in range(b.num_rows))
        head = next(rows, None)
        while head is not None:
            following = None

            def own(at=(head["q"].as_py(), head["slice"].as_py())):
                nonlocal following
                for r in rows:
                    if (r["q"].as_py(), r["slice"].as_py()) != at:
                        following = r
                        return
                    yield r

            mine = own()
            yield from visit(head, mine)
            for _ in mine:  # what the visit left
                pass
            head = following

    n = max(1, q.sparkSession.sparkContext.defaultParallelism)
    both = q.unionByName(p).repartition(max(n, int(q.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))), "q", "slice")
    return both.sortWithinPartitions("q", "slice", "ord", "block").mapInArrow(run, schema)


def slices_for(n_blocks: int, n_queries: int, parallelism: int) -> int:
    """So many slices of a query block's work that every core has some; results do not depend on it."""
    return max(1, min(n_blocks, math.ceil(4 * parallelism / max(1, n_queries))))


def scores(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of integer vectors, exact: floating-point while their sums fit, else integers."""
    kind = np.float64 if exact else np.int64
    return a.astype(kind) @ b.astype(kind).T


def cells(s: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of fitting cells, those that cannot be among a row's ``k`` best left out.

    Columns are sorted by id, so of equal scores the first ``k`` are enough: a
    block of copies does not give a cell for each of them.
    """
    if s.shape[1] > k and np.count_nonzero(fits) > 2 * k * len(s):
        low = np.iinfo(np.int64).min if s.dtype == np.int64 else -np.inf
        held = np.where(fits, s, low)
        least = np.partition(held, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
        tied = fits & (s == least)
        fits = (fits & (s > least)) | (tied & (np.cumsum(tied, axis=1, dtype=np.int32) <= k))
    return np.nonzero(fits)


class Best:
    """The ``k`` best hits of each of ``n`` owners: higher score, then smaller id (null last)."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.owner, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        self.null, self.new = np.empty(0, bool), np.empty(0, bool)
        self.least = np.full(n, np.iinfo(np.int64).min)  # the k-th score once there are k

    def add(self, owner: np.ndarray, score: np.ndarray, id_: np.ndarray, null: np.ndarray, new: bool = True) -> None:
        if not len(owner):
            return
        self.new = np.concatenate([self.new, np.full(len(owner), new)])
        o, s = np.concatenate([self.owner, owner]), np.concatenate([self.score, score.astype(np.int64)])
        i, z = np.concatenate([self.id, id_]), np.concatenate([self.null, null])
        by = np.lexsort((i, z, -s, o))
        o, s, i, z = o[by], s[by], i[by], z[by]
        first = np.r_[True, o[1:] != o[:-1]]
        rank = np.arange(len(o)) - np.maximum.accumulate(np.where(first, np.arange(len(o)), 0))
        stay = rank < self.k
        self.owner, self.score, self.id, self.null, self.new = o[stay], s[stay], i[stay], z[stay], self.new[by][stay]
        last = rank[stay] == self.k - 1
        self.least[self.owner[last]] = self.score[last]


def ids_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Ids and which of them are null."""
    a = row["ids"].values
    return a.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(a.is_null())
