"""One JSON array read by many tasks: a parallel prefix scan over its bytes.

A JSON array has no record separator: what a byte means depends on all bytes
before it (inside a string or not, how deep).  But how a stretch of bytes *changes*
that state can be computed without knowing it, and the changes compose:

1. **Split anywhere.**  The file is read as text records that end in ``}``, which
   Spark splits at any byte range, from whatever store it can read.  A task joins
   its records to chunks of about ``CHUNK`` bytes.  As every chunk ends in ``}``, no
   backslash escapes across a border, so a chunk's entry state is one bit (inside
   a string) and a depth.
2. **Map.**  For both values of the bit a chunk gives its exit bit (the parity of its
   unescaped quotes) and its change of depth.
3. **Compose.**  Running sums over one narrow row per chunk, inside a split and then
   over one row per split, give each chunk's real entry state.
4. **Cut.**  With it, a chunk cuts its own elements at the commas of depth one.  An
   element that crosses borders leaves one piece per chunk; the pieces carry the
   element's number and are joined by it: no group is larger than an element.
5. **Parse.**  Element texts are parsed by Spark's JSON functions, so types, schema
   inference and malformed records are as in Spark's own reader, with one
   difference: a malformed element is one reject, not a reject of the whole file.

An unclosed last element is a reject; what follows the closing bracket is not
read.  Texts are UTF-8.  A file that does not begin with ``[`` is not an array and
is read as a whole by one task.  Compressed files cannot be split.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialogprep.session import ensure_checkpoint_dir

CHUNK = 1 << 20
CORRUPT = "_corrupt_record"
BLANKS = b" \t\r\n"  # of JSON

_CHUNKS = "f string, b long, c int, text binary"
_STATES = "f string, b long, c int, quotes int, d0 long, d1 long, head int"
_PIECES = "f string, b long, c int, i int, starts boolean, ends boolean, text binary"


def chunks(spark: SparkSession, path: str | list[str], size: int = CHUNK) -> DataFrame:
    """``f, b, c, text``: the bytes of each file split, in pieces that end in ``}``.

    A last record without ``}`` gets one as well; it falls behind the array's end,
    or into an element that is never closed.
    """
    text = spark.read.option("lineSep", "}").text(path)
    text = text.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, c, held, n = None, 0, [], 0

        def out() -> pa.RecordBatch:
            nonlocal held, n, c
            row = pa.record_batch({"f": [at[0]], "b": pa.array([at[1]], pa.int64()), "c": pa.array([c], pa.int32()), "text": pa.array([b"".join(held)], pa.binary())})
            held, n, c = [], 0, c + 1
            return row

        for batch in batches:
            f, b = batch.column("f").dictionary_encode(), batch.column("b").to_numpy()
            code = f.indices.to_numpy()
            cut = [0, *(np.flatnonzero((code[1:] != code[:-1]) | (b[1:] != b[:-1])) + 1).tolist(), len(b)]
            ends = np.cumsum(pc.binary_length(batch.column("value")).to_numpy() + 1)
            for a, z in zip(cut[:-1], cut[1:], strict=True):
                if a == z:
                    continue
                here = (f[a].as_py(), int(b[a]))
                if here != at:
                    if n:
                        yield out()
                    at, c = here, 0
                while a < z:
                    # As many records as fill the chunk, at least one.
                    to = min(z, max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size - n, side="right"))))
                    part = pa.ListArray.from_arrays(pa.array([0, to - a], pa.int32()), batch.column("value").slice(a, to - a).cast(pa.binary()))
                    held += [pc.binary_join(part, b"}")[0].as_py(), b"}"]
                    n += int(ends[to - 1] - (ends[a - 1] if a else 0))
                    a = to
                    if n >= size:
                        yield out()
        if n:
            yield out()

    return text.mapInArrow(run, _CHUNKS)


def lexed(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, parity of the unescaped quotes before each byte, change of depth at each byte if it is outside a string)."""
    a = np.frombuffer(text, np.uint8)
    quote = a == 0x22
    slash = np.flatnonzero(a == 0x5C)
    if len(slash):
        # Runs of backslashes: one of odd length escapes what follows it.
        first = np.r_[True, np.diff(slash) != 1]
        start = slash[first]
        length = np.diff(np.r_[np.flatnonzero(first), len(slash)])
        escaped = (start + length)[length % 2 == 1]
        quote[escaped[escaped < len(a)]] = False
    parity = (np.cumsum(quote) - quote) & 1
    depth = ((a == 0x7B) | (a == 0x5B)).astype(np.int8) - ((a == 0x7D) | (a == 0x5D)).astype(np.int8)
    return a, parity.astype(bool), depth


def changes(text: DataFrame) -> DataFrame:
    """Step 2: per chunk the parity of its quotes, its change of depth if entered outside (``d0``) or inside (``d1``)
    a string, and its first byte that is not blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                raw = batch.column("text")[i].as_py()
                _, inside, depth = lexed(raw)  # a chunk ends in }, so the last parity is that of all
                head = raw.lstrip(BLANKS + b"\xef\xbb\xbf")[:1]
                rows.append((int(inside[-1]), int(depth[~inside].sum(dtype=np.int64)), int(depth[inside].sum(dtype=np.int64)), head[0] if head else 0))
            q, d0, d1, head = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.record_batch([batch.column("f"), batch.column("b"), batch.column("c"), pa.array(q, pa.int32()), pa.array(d0, pa.int64()), pa.array(d1, pa.int64()), pa.array(head, pa.int32())],
                                  names=["f", "b", "c", "quotes", "d0", "d1", "head"])

    return text.mapInArrow(run, _STATES)


def before(rows: DataFrame, value: Column, out: str) -> DataFrame:
    """Adds the sum of ``value`` over all earlier chunks of the file: inside the split, and over the splits before it."""
    d = rows.withColumn("_v", value)
    total = d.groupBy("f", "b").agg(F.sum("_v").alias("_s"))
    prior = Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    offset = total.select("f", "b", F.coalesce(F.sum("_s").over(prior), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("f", "b").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)  # one row per chunk of a split
    d = d.withColumn(out, F.coalesce(F.sum("_v").over(inside), F.lit(0))).join(offset, ["f", "b"])
    return d.withColumn(out, F.col(out) + F.col("_o")).drop("_v", "_o")


def entry_states(changed: DataFrame) -> DataFrame:
    """Step 3: ``f, b, c, inside, depth`` at the begin of each chunk."""
    d = before(changed, F.col("quotes"), "_q").withColumn("inside", (F.col("_q") % 2).cast("int"))
    d = before(d, F.when(F.col("inside") == 1, F.col("d1")).otherwise(F.col("d0")), "depth")
    return d.select("f", "b", "c", "inside", "depth")


def cut(text: bytes, inside: int, depth: int, first: bool) -> list[tuple[int, int, bool, bool]]:
    """Step 4: (begin, end, starts here, ends here) of the elements' parts in a chunk."""
    a, parity, change = lexed(text)
    outside = ~(parity ^ bool(inside))
    level = depth + np.cumsum(np.where(outside, change, 0))  # behind each byte
    begin = 0
    if depth < 1:
        rise = np.flatnonzero(level >= 1)
        if not (first and len(rise) and a[rise[0]] == 0x5B):  # an array begins in the first chunk
            return []
        begin = int(rise[0]) + 1
    closed = np.flatnonzero(level[begin:] <= 0)
    end = begin + int(closed[0]) if len(closed) else len(a)
    done = bool(len(closed)) and a[end] == 0x5D
    comma = np.flatnonzero((a[begin:end] == 0x2C) & outside[begin:end] & (level[begin:end] == 1)) + begin
    edges = [begin - 1, *comma.tolist(), end]
    last = len(edges) - 2
    return [(x + 1, y, n > 0 or depth < 1, n < last or done) for n, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True))]


def pieces(text: DataFrame, states: DataFrame) -> DataFrame:
    """Step 4: the elements' parts; ``i`` counts those that start in the chunk, -1 goes on with an earlier one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                raw, f, b, c, inside, depth = (batch.column(x)[r].as_py() for x in ("text", "f", "b", "c", "inside", "depth"))
                parts = [(raw[x:y].strip(BLANKS) if s and e else raw[x:y], s, e) for x, y, s, e in cut(raw, inside, depth, b == 0 and c == 0)]
                if len(parts) == 1 and parts[0] == (b"", True, True):
                    continue  # "[]" holds no element; an empty one beside a comma is malformed
                n = len(parts)
                lead = 0 if n and parts[0][1] else 1
                yield pa.record_batch([pa.array([f] * n, pa.string()), pa.array([b] * n, pa.int64()), pa.array([c] * n, pa.int32()), pa.array(range(-lead, n - lead), pa.int32()),
                                       pa.array([p[1] for p in parts], pa.bool_()), pa.array([p[2] for p in parts], pa.bool_()), pa.array([p[0] for p in parts], pa.binary())],
                                      names=["f", "b", "c", "i", "starts", "ends", "text"])

    placed = text.join(states, ["f", "b", "c"])  # a chunk is cut on its own, so their order need not hold
    return placed.mapInArrow(run, _PIECES)


def elements(text: DataFrame, changed: DataFrame) -> DataFrame:
    """``f, pos, value, closed``: the element texts of the arrays with their positions in their files."""
    parts = pieces(text, entry_states(changed)).checkpoint()
    # Per chunk: elements that start in it, and whether the last of them stays open.
    per = parts.groupBy("f", "b", "c").agg(F.count_if("starts").alias("_n"), F.count_if(F.col("starts") & ~F.col("ends")).alias("_open"))
    per = changed.select("f", "b", "c").join(per, ["f", "b", "c"], "left").fillna(0, ["_n", "_open"])
    per = before(before(per, F.col("_n"), "n0"), F.col("_open"), "o0").select("f", "b", "c", "n0", "o0")
    d = parts.join(per, ["f", "b", "c"]).withColumn("pos", F.when(F.col("starts"), F.col("n0") + F.col("i")))
    whole = d.filter(F.col("starts") & F.col("ends")).select("f", "pos", F.col("text").cast("string").alias("value"), F.lit(True).alias("closed"))
    # The parts of an element that crosses chunks meet under the number of the open element they belong to.
    cross = d.filter(~(F.col("starts") & F.col("ends"))).withColumn("o", F.col("o0") + F.col("starts").cast("long"))
    joined = cross.groupBy("f", "o").agg(F.max("pos").alias("pos"), F.bool_or("ends").alias("closed"), F.array_sort(F.collect_list(F.struct("b", "c", "i", "text"))).alias("p"))
    raw = F.aggregate("p", F.lit(b"").cast("binary"), lambda z, x: F.concat(z, x["text"]))
    joined = joined.withColumn("value", F.btrim(raw.cast("string"), F.lit(BLANKS.decode())))
    return whole.unionByName(joined.select("f", "pos", "value", "closed"))


def _inferred(values: DataFrame) -> T.StructType:
    """The schema Spark's JSON reader infers for texts of one record each."""
    session = values.sparkSession
    rows = getattr(values._jdf, "as")(session._jvm.org.apache.spark.sql.Encoders.STRING())
    return T.StructType.fromJson(json.loads(session._jsparkSession.read().option("columnNameOfCorruptRecord", CORRUPT).json(rows).schema().json()))


def read_json_array(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None, size: int = CHUNK) -> DataFrame:
    """The records of JSON array files, one row per element, with ``_file`` (ordinal by name) and ``_pos`` (from 0).

    As ``spark.read.option("multiLine", True).json(path)``, but a file is read by
    as many tasks as it has splits.  Malformed elements come as ``_corrupt_record``
    if the schema has it, or if there are any.  Files that hold no array are read
    as that reader does.
    """
    ensure_checkpoint_dir(spark)
    text = chunks(spark, path, size)
    changed = changes(text).checkpoint()
    rows = elements(text, changed).withColumn("closed", F.col("closed") & (F.col("value") != ""))
    files = changed.filter("b = 0 AND c = 0").select("f", "head")
    others = [_plain(spark, r.f) for r in files.filter(F.col("head") != ord("[")).collect()]
    if schema is None:
        schema = _inferred(rows.filter("closed").select("value"))
        if CORRUPT not in schema.fieldNames() and not rows.filter("NOT closed").isEmpty():
            schema = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    full = schema if CORRUPT in schema.fieldNames() else T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    parsed = F.when(F.col("closed"), F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    rows = rows.select("f", "pos", "value", "closed", parsed.alias("_r"))
    fields = [F.when(F.col("closed"), F.col("_r")[CORRUPT]).otherwise(F.col("value")).alias(n) if n == CORRUPT else F.col("_r")[n].alias(n) for n in schema.fieldNames()]
    out = rows.select("f", F.col("pos").alias("_pos"), *fields)
    if others:
        plain = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", CORRUPT).json(others)
        seen = plain.select(F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("_m"), *schema.fieldNames())
        in_file = Window.partitionBy("f").orderBy("_m")
        out = out.unionByName(seen.withColumn("_pos", F.row_number().over(in_file).cast("long") - 1).drop("_m"))
    ordinal = files.select("f", (F.dense_rank().over(Window.orderBy("f")) - 1).cast("int").alias("_file"))  # one row per file
    return out.join(ordinal, "f").drop("f")


def _plain(spark: SparkSession, uri: str) -> str:
    """A file's path from its encoded form."""
    return spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(uri)).toString()
