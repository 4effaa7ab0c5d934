"""Nesting flat turn tables into dialogue records, and the table adapters.

F1 is the only shuffle of the training-set build: turns are grouped by
conversation with ``collect_list`` (an ObjectHashAggregate with a map-side
partial aggregate, so every map task ships at most one partial list per
conversation).  Everything derived from the assembled row afterwards -
target, kept turns, keywords - is a row-local expression: no second scan and
no join back.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialogprep.operators.ordinal import order_rank
from dialogprep.schema import PromptText
from dialogprep.session import ensure_checkpoint_dir

KEYWORD_PATTERN = "[a-z]{4,}"


def assemble_conversations(
    turns: DataFrame,
    key: str = "conv_id",
    order: str = "turn",
    fields: tuple[str, ...] = ("role", "text"),
    out: str = "turns",
) -> DataFrame:
    """one row per conversation with its turns ordered by ``order``."""
    return turns.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(order, *fields))).alias(out)
    )


def top_keywords(words: Column, k: int = 2) -> Column:
    """The ``k`` most frequent strings of an array, ordered by (count desc, word asc).

    One pass over the sorted array keeps the running count of the current word
    and the best ``k`` (word, count) pairs - O(n log n) per row, no explode, no
    shuffle.  Only ``k = 2`` is needed by the adapter, so the state is unrolled.
    """
    if k != 2:
        raise ValueError("top_keywords is unrolled for k = 2")
    init = F.expr(
        "named_struct('w', CAST(NULL AS STRING), 'n', 0, 'w1', CAST(NULL AS STRING), "
        "'c1', 0, 'w2', CAST(NULL AS STRING), 'c2', 0)"
    )

    def step(a: Column, x: Column) -> Column:
        n = F.when(a["w"] == x, a["n"] + 1).otherwise(F.lit(1))
        keep_first = x.eqNullSafe(a["w1"])
        contender = x.eqNullSafe(a["w2"]) | (n > a["c2"])
        promote = contender & (n > a["c1"])

        def pick(first: Column, promoted: Column, second: Column, other: Column) -> Column:
            return (F.when(keep_first, first).when(promote, promoted)
                    .when(contender, second).otherwise(other))

        return F.struct(
            x.alias("w"),
            n.alias("n"),
            pick(a["w1"], x, a["w1"], a["w1"]).alias("w1"),
            pick(n, n, a["c1"], a["c1"]).alias("c1"),
            pick(a["w2"], a["w1"], x, a["w2"]).alias("w2"),
            pick(a["c2"], a["c1"], n, a["c2"]).alias("c2"),
        )

    return F.aggregate(
        F.array_sort(F.coalesce(words, F.array().cast("array<string>"))),
        init,
        step,
        lambda a: F.filter(F.array(a["w1"], a["w2"]), lambda z: z.isNotNull()),
    )


def examples_from_turns(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Dialogue records (example_id, input, output) from a flat turn table.

    ``output`` is the last assistant turn ('' if none); the conversation is the
    non-system turns before it; ``subject_keyword`` holds the two most frequent
    ``[a-z]{4,}`` words of the lower-cased utterances.
    """
    a = assemble_conversations(turns.select(key, "turn", "role", "text"), key=key)
    ts = F.col("turns")
    last = F.array_max(F.transform(F.filter(ts, lambda t: t["role"] == "assistant"), lambda t: t["turn"]))
    a = a.withColumn("_last", last)
    output = F.coalesce(F.get(F.filter(ts, lambda t: t["turn"] == F.col("_last")), 0)["text"], F.lit(""))
    kept = F.filter(
        ts, lambda t: (t["role"] != "system") & (F.col("_last").isNull() | (t["turn"] < F.col("_last")))
    )
    conv = F.transform(kept, lambda t: F.struct(t["role"].alias("speaker"), t["text"].alias("utterance")))
    a = a.withColumn("_conv", conv)
    words = F.flatten(
        F.transform(
            F.col("_conv"),
            lambda u: F.regexp_extract_all(F.lower(F.coalesce(u["utterance"], F.lit(""))),
                                           F.lit(KEYWORD_PATTERN), 0),
        )
    )
    return a.select(
        F.col(key).alias("example_id"),
        F.struct(F.col("_conv").alias("conversation"), top_keywords(words).alias("subject_keyword")).alias("input"),
        output.alias("output"),
    )


def pool_from_table(df: DataFrame, order_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Few-shot pool (pos, text): ``pos`` = 0-based rank of ``order_col``.

    Numbered by ranges of the order (no single-task window).
    """
    ranked = order_rank(df.select(order_col, text_col), order_col, "pos")
    return ranked.select(F.col("pos").cast("int").alias("pos"), F.col(text_col).alias("text"))


def preferences_from_turns(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Preference pairs from conversations with at least two assistant turns.

    prompt = first user text, chosen = last assistant text, rejected = first
    assistant text.  Plain partial-aggregatable aggregates (no collect).
    """
    agg = turns.groupBy(key).agg(
        F.expr("min_by(text, turn) FILTER (WHERE role = 'user')").alias("prompt"),
        F.expr("max_by(text, turn) FILTER (WHERE role = 'assistant')").alias("chosen"),
        F.expr("min_by(text, turn) FILTER (WHERE role = 'assistant')").alias("rejected"),
        F.expr("count(*) FILTER (WHERE role = 'assistant')").alias("_n_asst"),
    )
    return agg.filter(F.col("_n_asst") >= 2).select(
        F.col(key).alias("example_id"), "prompt", "chosen", "rejected"
    )


# -- conversations too long for one row ------------------------------------------
CHUNK_BYTES = 4 << 20  # of text in a chunk of turns
RANGE_BYTES = 256 << 20  # of text that one task sorts and cuts


def assemble_chunks(turns: DataFrame, key: str = "conv_id", order: str = "turn", fields: tuple[str, ...] = ("role", "text"),
                    max_bytes: int = CHUNK_BYTES, out: str = "turns") -> DataFrame:
    """F1 without a bound on a conversation: rows (key, chunk, turns), chunks of about ``max_bytes`` of text in order.

    A turn belongs to chunk ``floor(bytes of the conversation's turns before it /
    max_bytes)``, so the cut depends on the data alone; a conversation of up to
    ``max_bytes`` is chunk 0, the row :func:`assemble_conversations` makes.  A turn
    longer than that is a chunk of its own or ends one.

    Turns are sorted by (key, order, fields) into ranges of about ``RANGE_BYTES``,
    a hot conversation into many.  One narrow row per (range, conversation) tells
    how much of a range's first conversation lies in ranges before it.  A task then
    cuts its sorted turns while they pass; only chunks at a range's borders move
    again, to meet their other part.  So no task holds more than a chunk of a
    conversation, and nothing is cut off.
    """
    ensure_checkpoint_dir(turns.sparkSession)
    size = sum((F.coalesce(F.octet_length(F.col(f).cast("string")), F.lit(0)) for f in fields), F.lit(0)).cast("long")
    rows = turns.select(F.col(key).alias("k"), F.col(order).alias("o"), F.struct(order, *fields).alias("t"), size.alias("size"))
    total = rows.agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).head()
    cores = turns.sparkSession.sparkContext.defaultParallelism
    n = max(1, math.ceil((total.s or 0) / RANGE_BYTES), min(cores, math.ceil(total.n / 1000)))
    by = [F.asc("k"), F.asc("o"), F.asc("h"), F.asc("i")]  # turns alike in all are split by i
    rows = rows.withColumn("h", F.xxhash64("t")).withColumn("i", F.monotonically_increasing_id())
    placed = rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("pos", F.monotonically_increasing_id())
    placed = placed.drop("h", "i", "o").withColumn("r", F.shiftright("pos", 33)).checkpoint()
    # How many bytes of a range's first conversation stand in the ranges before.
    per = placed.groupBy("r", "k").agg(F.sum("size").alias("s"), F.min("pos").alias("p"))
    earlier = Window.partitionBy("k").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    per = per.withColumn("before", F.coalesce(F.sum("s").over(earlier), F.lit(0)))
    first = per.groupBy("r").agg(F.min_by("before", "p").alias("before"))
    placed = placed.join(first, "r").sortWithinPartitions("pos")

    tt = placed.schema["t"].dataType
    schema = T.StructType([T.StructField("k", placed.schema["k"].dataType), T.StructField("chunk", T.LongType()), T.StructField("pos", T.LongType()),
                           T.StructField("edge", T.BooleanType()), T.StructField("turns", T.ArrayType(tt))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, pos, begun, run, r = None, [], 0, True, 0, -1
        names = [f.name for f in schema]

        def out_row(edge: bool) -> pa.RecordBatch:
            t = pa.chunked_array(held).combine_chunks()
            t = t.combine_chunks() if isinstance(t, pa.ChunkedArray) else t
            return pa.record_batch([now[0], pa.array([now[1]], pa.int64()), pa.array([pos], pa.int64()), pa.array([edge]),
                                    pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), t)], names=names)

        for b in batches:
            k, turn = b.column("k"), b.column("t")
            code = k.dictionary_encode().indices.to_pylist()
            ranges, sizes, before, places = (b.column(c).to_numpy() for c in ("r", "size", "before", "pos"))
            a = 0
            for i in range(b.num_rows):
                same_key = code[i] == code[i - 1] if i else now is not None and k[:1].equals(now[0])
                if ranges[i] != r:
                    new, run, edge = True, int(before[i]), True
                elif not same_key:
                    new, run, edge = True, 0, False
                else:
                    new, edge = run // max_bytes != now[1], False
                if new:
                    if i > a:
                        held.append(turn.slice(a, i - a))
                    if held:
                        yield out_row(begun or ranges[i] != r)
                    now, held, a, pos, begun, r = (k.slice(i, 1), run // max_bytes), [], i, int(places[i]), edge, int(ranges[i])
                run += int(sizes[i])
            if b.num_rows > a:
                held.append(turn.slice(a))
        if held:
            yield out_row(True)

    pieces = placed.mapInArrow(cut, schema).checkpoint()
    whole = pieces.filter(~F.col("edge")).select("k", "chunk", "turns")
    met = pieces.filter("edge").groupBy("k", "chunk").agg(F.array_sort(F.collect_list(F.struct("pos", "turns"))).alias("p"))
    met = met.select("k", "chunk", F.flatten(F.transform("p", lambda x: x["turns"])).alias("turns"))
    return whole.unionByName(met).select(F.col("k").alias(key), "chunk", F.col("turns").alias(out))


def chunk_text(turns: Column, chunk: Column, text: PromptText = PromptText()) -> Column:
    """B2 for a chunk of (role, text) turns: the chunks' texts in order are the conversation's transcript."""
    lines = F.transform(turns, lambda t: F.concat(F.lit("\n"), F.coalesce(t["role"], F.lit("")), F.lit(text.turn_separator), F.coalesce(t["text"], F.lit(""))))
    return F.concat(F.when(chunk == 0, F.lit(text.conversation_header)).otherwise(F.lit("")), F.array_join(lines, ""))


def chunk_rows(chunks: DataFrame, tokenizer, key: str = "conv_id") -> DataFrame:
    """C1, C2, C7, C8 on chunks: domain-adaptation rows (key, chunk, input_ids, labels, attention_mask).

    The chunks' ids in order are those of the whole transcript (a tokenizer whose
    ids of a text are those of its parts, as the code-point one's), the start id
    with the first chunk only.  ``pack(key=[key, "chunk"])`` takes them from here.
    """
    body = tokenizer.encode(chunk_text(F.col("turns"), F.col("chunk")), add_special=False)
    start = F.when(F.col("chunk") == 0, F.array(F.lit(tokenizer.bos_token_id))).otherwise(F.array().cast("array<int>"))
    d = chunks.select(key, "chunk", F.concat(start, body).alias("input_ids"))
    return d.select(key, "chunk", "input_ids", F.col("input_ids").alias("labels"), F.array_repeat(F.lit(1), F.size("input_ids")).alias("attention_mask"))
