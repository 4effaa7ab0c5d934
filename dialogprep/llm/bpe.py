"""Byte-level BPE encoding and decoding by tree reduction.

A text is cut by the split pattern, and each piece is encoded by itself.  The
encoding of a piece is a monoid reduction: the leaves are single bytes and parts
that are one token, any other part is cut in two, both are encoded, and the
neighbours ``a``, ``b`` are joined; long parts are cut in the middle, short ones
after the longest leaf they begin with.  A token sequence is the encoding of its bytes
exactly when each two neighbours, merged by rank, give themselves ("stable"
pairs).  So if the pair at the border is stable the two are just put together;
else a window of ``k`` tokens on either side is encoded again, and the window
grows (1, 2, 4, ... tokens) until the pairs across its two edges are stable:
every other pair is inside one encoding already.  Whether a pair is stable is
read from the tokens' own last merges, without merging.  Decoding is the same
reduction with concatenation: the places of all tokens' bytes are the running
sums of their lengths, so a batch is put together at once.

The vocabulary (a file of base64 token and rank per line) is read and its tables
are made by the driver and broadcast; they are bounded by the file.  Decoding gets
its own small tables, as each task that does both has two workers.  A text is first cut before each
blank that touches no other white space: the pattern cuts there in any case, so
the chunks between are independent, and those seen before come from a cache of
bounded size.

Defined results: null text is empty and has no tokens; special tokens are
ordinary text; very long texts are encoded whole, in one task, and a piece of n
bytes takes about n joins; repeated rows give repeated rows; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogprep.llm.common import text_of

KEPT_BYTES = 24
CACHE_CHARS = 48
CACHE_CHUNKS = 120_000
CACHE_MARKS = 1 << 20
CACHE_PAIRS = 1 << 17
ROWS_PER_BATCH = 256


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


def token_bytes(ranks: dict[bytes, int]) -> list[bytes]:
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


DECODE_TOKENS = 1 << 18


class Decoder:
    """Bytes of ids: a whole batch is put together by the running sums of the tokens' lengths."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = token_bytes(ranks)
        self.size = np.array([len(t) for t in tokens], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def bytes(self, ids: np.ndarray) -> bytes:
        parts = []
        for at in range(0, len(ids), DECODE_TOKENS):
            size = self.size[ids[at:at + DECODE_TOKENS]]
            begin = np.cumsum(size) - size
            parts.append(self.flat[np.repeat(self.start[ids[at:at + DECODE_TOKENS]] - begin, size) + np.arange(int(size.sum()))].tobytes())
        return b"".join(parts)

    def batch(self, ids: np.ndarray, rows: np.ndarray) -> pa.Array:
        """A binary column: row ``i`` has the ids from ``rows[i]`` to ``rows[i + 1]``."""
        ends = np.r_[0, np.cumsum(self.size[ids])][rows]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(self.bytes(ids))])


class _Chunks(dict):
    """Encodings of chunks as packed ids, made when first asked for.

    A chunk is kept when it is asked for again, since most are met only once;
    ``met`` has a mark for each that was made, by hash.  When the cache is full
    it becomes the old one, and chunks still in use come back from there.
    """

    def __init__(self, make):
        self.make = make
        self.old: dict[str, bytes] = {}
        self.met, self.marks = bytearray(CACHE_MARKS), 0

    def __missing__(self, chunk: str) -> bytes:
        packed = self.old.get(chunk)
        if packed is None:
            packed = self.make(chunk)
            mark = hash(chunk) % CACHE_MARKS
            if not self.met[mark]:
                if self.marks >= CACHE_MARKS // 2:
                    self.met, self.marks = bytearray(CACHE_MARKS), 0
                self.met[mark] = 1
                self.marks += 1
                return packed
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= CACHE_CHUNKS:
                self.old = dict(self)
                self.clear()
            self[chunk] = packed
        return packed


def merge(ranks: dict[bytes, int], piece: bytes, down_to: int = 1) -> list[bytes]:
    """Merge the neighbours of least rank, leftmost first, until none merge or ``down_to`` parts are left."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    none = 1 << 60
    near = [ranks.get(piece[i:i + 2], none) for i in range(len(piece) - 1)]
    while len(near) >= down_to:
        least = min(near)
        if least == none:
            break
        i = near.index(least)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del near[i]
        if i < len(near):
            near[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            near[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return parts


class Vocabulary:
    """Ranks and, made once from them, what joins need."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        #: Tokens that merging their own bytes makes; others only stand for a whole piece.
        self.tokens: dict[bytes, int] = {}
        #: The two tokens whose merge made a token (-1: none), and the other way round, in one number.
        self.left = array("i", [-1]) * (max(ranks.values(), default=-1) + 1)
        self.right = array("i", self.left)
        self.made: dict[int, int] = {}
        for t, r in ranks.items():
            two = merge(ranks, t, down_to=2)
            if len(two) == 1:
                self.tokens[t] = r
            elif len(two) == 2 and ranks.get(two[0] + two[1]) == r:
                self.tokens[t] = r
                self.left[r], self.right[r] = a, b = ranks[two[0]], ranks[two[1]]
                self.made[a << 32 | b] = r
        if len(self.tokens) == len(ranks):
            self.tokens = ranks


class BytePairCodec:
    """Encoder and decoder of one vocabulary; packed ids are little-endian int32."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        self.ranks, self.tokens, self.made = vocabulary.ranks, vocabulary.tokens, vocabulary.made
        self.left, self.right = vocabulary.left, vocabulary.right
        self.bytes_of = token_bytes(self.ranks)
        self.decoder = Decoder(self.ranks)
        self.findall = regex.compile(pattern).findall
        self.borders = regex.compile(r"(?V1)(?<=\S)(?= \S)")
        self.white = regex.findall(r"\s", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)])))
        self.chunks = _Chunks(self._encode_chunk)
        self.after_blank = _Chunks(lambda word: self._encode_chunk(" " + word))
        self.pairs: dict[int, bool | tuple[int, ...]] = {}
        self.joins = 0

    def border(self, a: int, b: int) -> bool | tuple[int, ...]:
        """True if the two tokens, side by side, encode to themselves; else the encoding of their bytes."""
        known = self.pairs.get(a << 32 | b)
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            known = self.pairs[a << 32 | b] = self._stable(a, b) or self._window(self.bytes_of[a] + self.bytes_of[b])
        return known

    def stable(self, a: int, b: int) -> bool:
        return self.border(a, b) is True

    def _stable(self, a: int, b: int) -> bool:
        """Undo the two tokens' merges, the latest first: no merge across the border may have come earlier.

        ``limit`` is the rank below which a merge across the border would have
        been made instead of the one just undone; of equal ranks the left one goes
        first, so that on the right a merge across of the same rank comes before it.
        """
        left, right, made, limit = self.left, self.right, self.made, 1 << 60
        while True:
            across = made.get(a << 32 | b)
            if across is not None and across < limit:
                return False
            last_a, last_b = a if left[a] >= 0 else -1, b if left[b] >= 0 else -1
            if last_a < 0 and last_b < 0:
                return True
            if last_a > last_b:
                limit, a = a, right[a]
            else:
                limit, b = b + 1, left[b]

    def join(self, a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the bytes of ``a`` followed by those of ``b``."""
        self.joins += 1
        if not a or not b:
            return a + b
        window = self.border(a[-1], b[0])
        if window is True:
            return a + b
        k = 1
        while True:
            left, right = a[:-k], b[k:]
            if (not left or self.stable(left[-1], window[0])) and (not right or self.stable(window[-1], right[0])):
                return left + window + right
            k *= 2
            window = self._window(b"".join([self.bytes_of[t] for t in a[-k:] + b[:k]]))

    def _window(self, piece: bytes) -> tuple[int, ...]:
        """The bytes around a border, merged anew."""
        token = self.tokens.get(piece)
        return (token,) if token is not None else tuple([self.ranks[p] for p in merge(self.ranks, piece)])

    def reduce(self, piece: bytes) -> tuple[int, ...]:
        """The encoding of a piece from those of its parts; a small one is cut after the longest leaf it begins with, as that border is mostly stable."""
        n, tokens, pairs = len(piece), self.tokens, self.pairs
        if n > KEPT_BYTES:
            cut = n // 2
            return self.join(self.reduce(piece[:cut]), self.reduce(piece[cut:]))
        known, at = (), 0
        while at < n:
            end = n
            while end > at + 1 and piece[at:end] not in tokens:
                end -= 1
            leaf = self.ranks[piece[at:end]]
            if known and pairs.get(known[-1] << 32 | leaf) is True:
                self.joins += 1
                known += (leaf,)
            else:
                known = self.join(known, (leaf,))
            at = end
        return known

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        return (whole,) if whole is not None else self.reduce(raw)

    def _encode_chunk(self, chunk: str) -> bytes:
        pieces = self.findall(chunk)
        if len(pieces) == 1:
            return array("i", self.encode_piece(chunk)).tobytes()
        # A piece is a chunk of its own.
        return b"".join(self.after_blank[p[1:]] if p[0] == " " and len(p) > 1 else self.chunks[p] for p in pieces)

    def blanks_touch(self, text: str) -> bool:
        """Whether a blank stands beside other white space."""
        return any(" " + c in text or c + " " in text for c in self.white if c in text)

    def encode_packed(self, text: str) -> bytes:
        if self.blanks_touch(text):
            return b"".join(map(self.chunks.__getitem__, self.borders.split(text)))
        first, *rest = text.split(" ")
        return self.chunks[first] + b"".join(map(self.after_blank.__getitem__, rest))

    def encode(self, text: str) -> list[int]:
        return array("i", self.encode_packed(text)).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return self.decoder.bytes(np.asarray(ids, dtype=np.int64))


_codecs: dict[str, BytePairCodec] = {}
_vocabularies: dict[str, Vocabulary] = {}  # of the driver, the last one


def _codec(key: str, shared, pattern: str) -> BytePairCodec:
    """This worker's codec of a broadcast vocabulary, kept with its cache."""
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = BytePairCodec(shared.value, pattern)
    return _codecs[key]


def _share(df: DataFrame, path: str, pattern: str):
    """The broadcast vocabulary, and a key that stands for its contents."""
    ranks = load_ranks(path)
    key = hashlib.md5(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()
    if key not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[key] = Vocabulary(ranks)
    return df.sparkSession.sparkContext.broadcast(_vocabularies[key]), key


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id, ids`` (array of int)."""
    shared, key = _share(docs, vocabulary, pattern)
    rows = docs.select(docs[id_col].alias("id"), text_of(docs[text_col]).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, shared, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_PER_BATCH):
                part = batch.slice(at, ROWS_PER_BATCH)
                packed = [codec.encode_packed(t.as_py()) for t in part.column(1)]
                ends = np.cumsum([0, *(len(x) // 4 for x in packed)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["id", "ids"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, pattern: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """``id, ids, bytes``: the bytes that the ids stand for."""
    shared = encoded.sparkSession.sparkContext.broadcast(Decoder(load_ranks(vocabulary)))  # tables only: a task of both has two workers
    rows = encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_PER_BATCH):
                part = batch.slice(at, ROWS_PER_BATCH)
                ids = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.r_[0, np.cumsum(part.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), decoder.batch(ids, ends).cast(pa.binary())], names=["id", "ids", "bytes"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, bytes binary")


def ids_text(ids) -> F.Column:
    return F.array_join(ids.cast("array<string>"), ",")
