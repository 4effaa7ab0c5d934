"""Conversation structure repair: the cheapest edits that make a conversation well-formed.

A conversation's rows, by turn, become symbols (role initial, fault); the edits
keep, re-role, delete or insert rows so that the role initials match
``(s?(ua)+)?``, at least cost and, of equal costs, with the ASCII-least letters.
Blank and repeated rows must go.  The search is the block tables' (Four
Russians, :mod:`dialogprep.llm.four_russians`).

Conversations are not gathered: rows are sorted by (conversation, turn) into
ranges of about ``ROWS`` rows, and a conversation may span ranges.

1. Each row gets its place in that order; the first place of every (conversation,
   role, text) is a partial aggregate over digests, and a row elsewhere is a repeat.
2. A range's task reads its rows in order.  Conversations inside the range are
   solved there.  Of those that may cross its borders it emits one piece: the
   symbols and the cost matrix between automaton states.
3. The pieces of a conversation, a few numbers each, are swept backward for the
   costs behind each piece, traced from every state, and swept forward for
   the state in which each piece is entered.
4. The letters meet the rows again, by range, and give the repaired lines.

A conversation with a third of all rows is that many ranges.  Only a digest of its
repaired text, SHA-256 being serial by definition, reads its kept lines one
after the other in one task, streaming, never holding more than a piece.

Defined results: null role and text are one space, null turns come first, rows of
one turn are ordered by a digest of role and text (equal rows are alike); a null
id is a conversation of its own; very long texts are digested and written whole;
a conversation of no rows needs no edits; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialogprep.llm import four_russians as fr
from dialogprep.llm.common import SPACE_CLASS, keep

ROWS = 100_000  # of a range
PIECE_BYTES = 1 << 20  # of repaired text that moves at once
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
_SPACES = " \t\n\x0b\x0c\r"

PIECES = ("ck string, r long, pos long, blank long, duplicate long, truncated long, illegal long, i0 int, i1 int, turns long, t0 long, t1 long, "
          "symbols binary, matrix array<bigint>, cost long, letters string")
LINES = "ck string, pos long, sub int, whole boolean, edit string, turn long, role string, text string"


@dataclass
class Repaired:
    """``summary``: ck, gaps, blank, duplicate, truncated, illegal, cost; ``lines``: one row per edit
    (:data:`LINES`, by ``pos, sub``; a deleted row has no role)."""

    summary: DataFrame
    lines: DataFrame


def conversation_key(conv: Column) -> Column:
    """The id as a text that is never null and differs for null."""
    return F.when(conv.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), conv.cast("string")))


def ordered(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows with their place in (conversation, turn) order; the high bits of ``pos`` are the range."""
    c = lambda n: df[f"`{n}`"]
    said = lambda n: F.coalesce(c(n).cast("string"), F.lit(" "))
    rows = df.select(conversation_key(c(conv)).alias("ck"), c(turn).cast("long").alias("turn"), said(role).alias("role"), said(text).alias("text"))
    mark = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    rows = rows.withColumn("mark", mark).withColumn("rid", F.monotonically_increasing_id())
    n, spread = df.count(), df.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(spread, math.ceil(n / 64)), math.ceil(n / ROWS))
    by = [F.asc("ck"), F.asc_nulls_first("turn"), F.asc("mark"), F.asc("rid")]  # rows alike in all else are split by rid
    rows = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("pos", F.monotonically_increasing_id())
    return keep(rows.drop("rid").withColumn("r", F.shiftright("pos", 33)))


def marked(rows: DataFrame) -> DataFrame:
    """``r, pos, ck, turn, initial, fault``: the narrow side of the rows."""
    last = F.substring(F.expr(f"rtrim('{''.join(chr(92) + f'u{ord(x):04x}' for x in _SPACES)}', text)"), -1, 1)
    blank = ~F.col("text").rlike(f"[^{SPACE_CLASS}]")
    initial = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    narrow = rows.select("r", "pos", "ck", "turn", "mark", initial.alias("initial"), blank.alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    first = narrow.groupBy("ck", "mark").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(0)
    return narrow.join(first, "pos", "left").select("r", "pos", "ck", "turn", "initial", fault.alias("fault"))


def pieces(narrow: DataFrame, parts: int) -> DataFrame:
    """One row per (range, conversation) of :data:`PIECES`; ``letters`` where the conversation lies inside the range."""

    def piece(ck: str, r: int, pos: int, at: list[np.ndarray], inside: bool) -> dict:
        initial, fault, turn, has = (np.concatenate(x) for x in zip(*at, strict=True))
        legal = ((initial[:-1] == 0) & (initial[1:] == 1)) | ((initial[:-1] == 1) & (initial[1:] == 2)) | ((initial[:-1] == 2) & (initial[1:] == 1))
        t = turn[has]  # sorted
        out = {"ck": ck, "r": r, "pos": pos, "blank": int((fault == BLANK).sum()), "duplicate": int((fault == DUPLICATE).sum()), "truncated": int((fault == TRUNCATED).sum()),
               "illegal": int((~legal).sum()), "i0": int(initial[0]), "i1": int(initial[-1]), "turns": int((t[1:] != t[:-1]).sum()) + 1 if len(t) else 0,
               "t0": int(t[0]) if len(t) else None, "t1": int(t[-1]) if len(t) else None, "symbols": None, "matrix": None, "cost": None, "letters": None}
        symbols = np.where((fault == BLANK) | (fault == DUPLICATE), fr.GONE, initial + 4 * (fault == TRUNCATED))
        tab = fr.tables()
        if inside:
            vector, cost, _ = tab.back(symbols, tab.end)
            letters, state = tab.edits(symbols, tab.end, fr.START)
            return out | {"cost": cost + tab.vectors[vector][fr.START], "letters": letters + tab.ending(state)}
        return out | {"symbols": symbols.astype(np.uint8).tobytes(), "matrix": sum(tab.piece(symbols), [])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(PIECES)
        now, start, at, fresh, made = None, 0, [], True, []
        for b in batches:
            ck, r, pos = b.column("ck"), b.column("r").to_numpy(), b.column("pos").to_numpy()
            turn = b.column("turn")
            cols = [b.column("initial").to_numpy(), b.column("fault").to_numpy(), turn.fill_null(0).to_numpy(), np.asarray(turn.is_valid())]
            code = ck.dictionary_encode().indices.to_numpy()
            cut = np.flatnonzero((code[1:] != code[:-1]) | (r[1:] != r[:-1])) + 1
            for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(r)], strict=True):
                if a == z:
                    continue
                key = (ck[a].as_py(), int(r[a]))
                if key != now:
                    if now is not None:
                        # The first and the last conversation of a range may go on outside.
                        made.append(piece(*now, start, at, not fresh and key[1] == now[1]))
                        fresh = key[1] != now[1]
                    now, start, at = key, int(pos[a]), []
                at.append([c[a:z] for c in cols])
                if len(made) >= 2000:
                    yield pa.RecordBatch.from_pylist(made, schema=schema)
                    made = []
        if now is not None:
            made.append(piece(*now, start, at, False))
        if made:
            yield pa.RecordBatch.from_pylist(made, schema=schema)

    return keep(narrow.repartition(parts, "r").sortWithinPartitions("pos").mapInArrow(run, PIECES))


_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()),
          "array<string>": pa.list_(pa.string())}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(n, _TYPES[t]) for n, t in (c.split(" ") for c in ddl.split(", "))])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        yield from b.to_pylist()


def _batched(rows: Iterator[dict], ddl: str, n: int = 2000, weigh: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``n`` rows and about ``weigh`` bytes of text."""
    schema, held, size = _arrow(ddl), [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row.values() if isinstance(x, (str, bytes)))
        if len(held) >= n or size >= weigh:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def solve_edges(edge: DataFrame) -> DataFrame:
    """``ck, r, pos, letters, entry, whole, cost`` of conversations that may cross ranges (``cost`` on their first piece)."""
    swept = "ck string, r long, behind array<bigint>, cost long, last boolean"

    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            now, f = None, fr.END
            for x in _rows(batches):
                last = x["ck"] != now
                now, f = x["ck"], fr.END if last else f
                m = x["matrix"]
                behind, f = f, fr.before([m[i:i + fr.STATES] for i in range(0, len(m), fr.STATES)], f)
                yield {"ck": now, "r": x["r"], "behind": list(behind), "cost": f[fr.START], "last": last}

        yield from _batched(rows(), swept)

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tab = fr.tables()

        def rows() -> Iterator[dict]:
            for x in _rows(batches):
                symbols = np.frombuffer(x["symbols"], np.uint8).astype(np.int64)
                vector = tab.at(tuple(x["behind"]))[0]
                # A state from which the end is out of reach is entered by no cheapest way.
                ways = [tab.edits(symbols, vector, s) if c < fr.INF else ("", s) for s, c in enumerate(fr.before(tab.piece(symbols), tuple(x["behind"])))]
                yield {"ck": x["ck"], "r": x["r"], "pos": x["pos"], "cost": x["cost"], "last": x["last"], "ways": [w for w, _ in ways], "exits": [e for _, e in ways]}

        yield from _batched(rows(), traced)

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            now, state = None, fr.START
            for x in _rows(batches):
                first = x["ck"] != now
                now, state = x["ck"], fr.START if first else state
                yield {"ck": now, "r": x["r"], "entry": state, "cost": x["cost"] if first else None, "whole": first and x["last"]}
                state = x["exits"][state]

        yield from _batched(rows(), entered)

    traced = "ck string, r long, pos long, cost long, last boolean, ways array<string>, exits array<bigint>"
    entered = "ck string, r long, entry int, cost long, whole boolean"
    costs = edge.select("ck", "r", "matrix").repartition("ck").sortWithinPartitions("ck", F.desc("r")).mapInArrow(backward, swept)
    ways = keep(edge.select("ck", "r", "pos", "symbols").join(costs, ["ck", "r"]).mapInArrow(trace, traced))
    states = ways.select("ck", "r", "exits", "cost", "last").repartition("ck").sortWithinPartitions("ck", "r").mapInArrow(forward, entered)
    out = F.get("exits", F.col("entry"))
    ending = F.when(~F.col("last"), "").when(out == fr.AFTER_S, "II").when(out == fr.AFTER_U, "I").otherwise("")
    got = ways.drop("cost").join(states, ["ck", "r"])
    return keep(got.select("ck", "r", "pos", F.concat(F.get("ways", F.col("entry")), ending).alias("letters"), "entry", "whole", "cost"))


def apply_letters(rows: DataFrame, edits: DataFrame, parts: int) -> DataFrame:
    """The repaired lines (:data:`LINES`): rows and their pieces' letters, merged by range in order."""
    a = rows.select("r", "pos", F.lit(1).alias("kind"), "ck", "turn", "role", "text", *[F.lit(None).cast(t).alias(c) for c, t in (("letters", "string"), ("entry", "int"), ("whole", "boolean"))])
    b = edits.select("r", "pos", F.lit(0).alias("kind"), "ck", *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"))], "letters", "entry", "whole")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_out() -> Iterator[dict]:
            letters, i, state, pos, at = "", 0, fr.START, 0, {}

            def inserts(last: bool) -> Iterator[dict]:
                nonlocal i, state
                sub = 1 if last else -1_000_000_000
                while i < len(letters) and letters[i] == "I":
                    to = fr.inserted(state)
                    yield at | {"pos": pos, "sub": sub, "edit": "I", "turn": None, "role": "assistant" if to == fr.AFTER_A else "user", "text": ""}
                    i, state, sub = i + 1, to, sub + 1

            for x in _rows(batches):
                if x["kind"] == 0:
                    yield from inserts(True)  # behind the last row of the piece before
                    letters, i, state = x["letters"], 0, x["entry"]
                    at = {"ck": x["ck"], "whole": x["whole"]}
                    continue
                pos = x["pos"]
                yield from inserts(False)
                edit, i = letters[i], i + 1
                role, text = (x["role"], x["text"]) if edit != "D" else (None, None)
                if edit == "K":
                    state = fr.MOVES[state, role[0]]
                elif edit == "R":
                    state = fr.inserted(state)
                    role = "assistant" if state == fr.AFTER_A else "user"
                yield at | {"pos": pos, "sub": 0, "edit": edit, "turn": x["turn"], "role": role, "text": text}
            yield from inserts(True)

        yield from _batched(rows_out(), LINES)

    return a.unionByName(b).repartition(parts, "r").sortWithinPartitions("pos", "kind").mapInArrow(run, LINES)


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repaired:
    """Faults, least cost and repaired lines of every conversation."""
    rows = ordered(df, conv, turn, role, text)
    parts = max(1, rows.rdd.getNumPartitions())
    found = pieces(marked(rows), parts)
    inner = found.filter("letters IS NOT NULL").select("ck", "r", "pos", "letters", F.lit(fr.START).alias("entry"), F.lit(True).alias("whole"), "cost")
    edits = inner.unionByName(solve_edges(found.filter("letters IS NULL")))
    w = Window.partitionBy("ck").orderBy("r")  # one row per piece
    seam = found.withColumns({"p1": F.lag("i1").over(w), "u1": F.max("t1").over(w.rowsBetween(Window.unboundedPreceding, -1))})
    legal = F.concat("p1", "i0").isin("01", "12", "21")
    counts = seam.groupBy("ck").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], (F.sum("illegal") + F.count_if(F.col("p1").isNotNull() & ~legal)).alias("illegal"),
        F.coalesce(F.max("t1") - F.min("t0") + 1 - F.sum("turns") + F.count_if(F.col("t0") == F.col("u1")), F.lit(0)).alias("gaps"))
    cost = edits.groupBy("ck").agg(F.sum("cost").alias("cost"))
    return Repaired(counts.join(cost, "ck").select("ck", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"), apply_letters(rows, edits, parts))


def digest(lines: DataFrame) -> DataFrame:
    """``ck, audit, repaired_sha256``: the letters in order and the hash of the lines ``role:text``.

    Lines come in order within a task.  A conversation that lies in one is hashed
    there; the parts of others move in pieces of ``PIECE_BYTES`` and are hashed in
    order, one after the other.
    """
    folded = "ck string, pos long, audit string, sha string, said binary"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            now, pos, r, audit, said, size, whole, sha = None, 0, 0, [], [], 0, False, None

            def out(last: bool) -> dict:
                if whole and last:
                    return {"ck": now, "pos": pos, "audit": "".join(audit), "sha": sha.hexdigest(), "said": None}
                return {"ck": now, "pos": pos, "audit": "".join(audit), "sha": None, "said": b"".join(said)}

            for x in _rows(batches):
                if x["ck"] != now or x["pos"] >> 33 != r:  # a task may hold ranges that do not follow each other
                    if now is not None:
                        yield out(True)
                    now, pos, r, audit, said, size, whole, sha = x["ck"], x["pos"], x["pos"] >> 33, [], [], 0, x["whole"], hashlib.sha256()
                    begun = False
                audit.append(x["edit"])
                size += 1
                if x["role"] is not None:
                    line = f"{x['role']}:{x['text']}".encode()
                    if whole:
                        sha.update(b"\n" + line if begun else line)
                        begun = True
                    else:
                        said.append(b"\n" + line)  # the first newline of all goes when the pieces meet
                        size += len(line)
                if not whole and size >= PIECE_BYTES:
                    yield out(False)
                    pos, audit, said, size = x["pos"] + 1, [], [], 0
            if now is not None and (audit or whole):
                yield out(True)

        yield from _batched(rows(), folded)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            now, audit, sha, begun = None, [], None, False
            for x in _rows(batches):
                if x["ck"] != now:
                    if now is not None:
                        yield {"ck": now, "audit": "".join(audit), "sha": sha.hexdigest()}
                    now, audit, sha, begun = x["ck"], [], hashlib.sha256(), False
                audit.append(x["audit"])
                if x["said"]:
                    sha.update(x["said"] if begun else x["said"][1:])
                    begun = True
            if now is not None:
                yield {"ck": now, "audit": "".join(audit), "sha": sha.hexdigest()}

        yield from _batched(rows(), joined)

    joined = "ck string, audit string, sha string"
    parts = keep(lines.mapInArrow(fold, folded))
    split = parts.filter("sha IS NULL").select("ck", "pos", "audit", "said").repartition("ck").sortWithinPartitions("ck", "pos").mapInArrow(join, joined)
    return parts.filter("sha IS NOT NULL").select("ck", "audit", "sha").unionByName(split).withColumnRenamed("sha", "repaired_sha256")
