"""LM scoring: word frequencies as a base, a subword lattice as the model.

1. Each task counts its words (Python, a batch at a time), and Spark sums them:
   one row per distinct word with its count ``c`` in the training documents.
2. The model's piece probabilities begin as the vocabulary's own scores and take
   one step towards the training words: expected uses of each piece over the
   lattices of all training words, plus ``PRIOR`` pseudo-uses of the scores.
   The result has one number per piece of the vocabulary file.
3. Each distinct word gets its base and its lattice log-probability once.
4. Words above ``1 / HEAVY`` of all tokens (so at most ``HEAVY`` words, whatever
   the input) are broadcast, and documents sum them where they are read.  The
   other words meet their scores in a join on the word, where no word can hold
   more than that share; their sums return to the documents by key.

A document's lattice score is the sum over its words (segmentations do not
cross white space) and its end.

Defined results: null text is empty, which is the end token alone; a null id
counts as the empty text in the hash; repeated rows give repeated rows; without
training documents every count is 0 and the model is the vocabulary's scores;
an empty table gives no rows; other columns are not read.  Words of any length
are scored, and counted into the model, as a whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogprep.llm.common import id_crc, keep, text_of
from dialogprep.llm.lattice import BEGIN, Lattice, load_pieces, prior

HEAVY = 200_000
PRIOR = 10_000.0
SMOOTH = 0.1
HOLD_OUT = 10
FLUSH = 200_000
LN10 = math.log(10)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(held_out, text) -> (word, c): counts in training rows; 0 if only held out."""
    def rows(seen):
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

    seen: Counter = Counter()
    for batch in batches:
        for held, text in zip(batch.column(0), batch.column(1)):
            found = text.as_py().encode("utf-8", "surrogatepass").lower().split()
            if held.as_py():
                for w in set(found):
                    seen[w] += 0
            else:
                seen.update(found)
            if len(seen) > FLUSH:
                yield rows(seen)
                seen.clear()
    yield rows(seen)


def _as_words(column: pa.Array) -> list[str]:
    return [BEGIN + w.decode("utf-8", "replace") for w in column.to_pylist()]


def word_counts(rows: DataFrame) -> DataFrame:
    """``word, c`` from rows of ``held_out, text``."""
    local = rows.select("held_out", "text").mapInArrow(_count, "word binary, c long")
    return local.groupBy("word").agg(F.sum("c").alias("c"))


def train_pieces(counts: DataFrame, n_docs: int, pieces: list[str], scores: list[float]) -> tuple[np.ndarray, float, float]:
    """Log-probabilities of the pieces, of one byte, and of the end."""
    # The end ranks with the most common piece, a byte with the rarest.
    p = prior([*scores, max(scores, default=0.0), min(scores, default=0.0)])
    spark = counts.sparkSession
    log_p, log_byte = np.log(p[:-2]), float(np.log(p[-1]))
    shared = spark.sparkContext.broadcast((pieces, log_p, log_byte))

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, total = None, np.zeros(len(shared.value[0]))
        for batch in batches:
            lattice = lattice or Lattice(*shared.value)
            total += lattice.expected(_as_words(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.float64())], names=["piece", "uses"])

    uses = np.zeros(len(p))
    part = counts.filter("c > 0").select("word", "c").mapInArrow(expect, "piece int, uses double")
    for r in part.groupBy("piece").agg(F.sum("uses").alias("uses")).collect():  # one row per piece of the vocabulary file
        uses[r["piece"]] = r["uses"]
    uses[-2] = n_docs
    q = uses + PRIOR * p
    q = np.log(q / q.sum())
    return q[:-2], float(q[-1]), float(q[-2])


def score_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", hold_out: int = HOLD_OUT) -> DataFrame:
    """One row per document: ``id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].alias("id"), (F.pmod(id_crc(docs[id_col]), F.lit(hold_out)) == 0).alias("held_out"), text_of(docs[text_col]).alias("text"))
    counts = keep(word_counts(rows))
    n_docs = rows.filter("not held_out").count()
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0)).alias("v")).first()
    n_train, n_distinct = total["n"] + n_docs, total["v"] + (1 if n_docs else 0)
    pieces, scores = load_pieces(vocabulary)
    log_p, log_byte, log_end = train_pieces(counts, n_docs, pieces, scores)
    model = spark.sparkContext.broadcast((pieces, log_p, log_byte))
    denominator = n_train + SMOOTH * (n_distinct + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = None
        for batch in batches:
            lattice = lattice or Lattice(*model.value)
            c = batch.column(1).to_numpy(zero_copy_only=False)
            base, lp = np.log10((c + SMOOTH) / denominator), lattice.score(_as_words(batch.column(0))) / LN10
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(c > 0), pa.array(base), pa.array(lp)], names=["word", "known", "base", "lp"])

    least = n_train / HEAVY
    heavy = counts.filter(F.col("c") > least).select("word", "c").mapInArrow(score, "word binary, known boolean, base double, lp double").collect()  # at most HEAVY rows
    common = spark.sparkContext.broadcast({bytes(r["word"]): (r["base"], r["lp"]) for r in heavy})
    end = (1 if n_docs else 0, math.log10((n_docs + SMOOTH) / denominator), log_end / LN10)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, h, text) -> a head row per document with its common words' sums,
        and a row per other word with its count."""
        table = common.value
        head = pa.struct([("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("lp", pa.float64())])
        names = ["id", "h", "word", "n", "head"]
        for batch in batches:
            at, word, n, heads = [], [], [], []
            for k, (text, held) in enumerate(zip(batch.column(2), batch.column(3))):
                found = text.as_py().encode("utf-8", "surrogatepass").lower().split()
                known, base, lp = end
                start = len(at)
                at.append(k)
                word.append(b" %d" % (k * 7919 + len(found)))  # no word begins with a space; deals the heads out
                n.append(0)
                heads.append(None)
                for w, m in Counter(found).items():
                    s = table.get(w)
                    if s is None:
                        at.append(k)
                        word.append(w)
                        n.append(m)
                        heads.append(None)
                    else:
                        known += m
                        base += m * s[0]
                        lp += m * s[1]
                heads[start] = {"held_out": held.as_py(), "n_tokens": len(found) + 1, "known": known, "base": base, "lp": lp}
                if len(at) >= FLUSH:
                    yield pack(batch, at, word, n, heads, head, names)
                    at, word, n, heads = [], [], [], []
            if at:
                yield pack(batch, at, word, n, heads, head, names)

    def pack(batch, at, word, n, heads, head, names):
        where = pa.array(at, pa.int32())
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(where), batch.column(1).take(where), pa.array(word, pa.binary()), pa.array(n, pa.int32()), pa.array(heads, head)], names=names)

    keyed = rows.select("id", F.xxhash64("text").alias("h"), "text", "held_out")
    kind = rows.schema["id"].dataType.simpleString()
    found = keyed.mapInArrow(sums, f"id {kind}, h long, word binary, n int, head struct<held_out:boolean,n_tokens:long,known:long,base:double,lp:double>")
    rare = counts.filter(F.col("c") <= least).select("word", "c").mapInArrow(score, "word binary, known boolean, base double, lp double")
    rare = rare.withColumnRenamed("word", "w")
    both = found.join(rare, found["word"] == rare["w"], "left")
    # Rows that repeat id and text add up under one key and are told apart again below.
    per = both.groupBy("id", "h").agg(
        F.count("head").alias("rows"), F.max("head.held_out").alias("held_out"), F.sum("head.n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("head.known", F.when(F.col("known"), F.col("n")), F.lit(0)).cast("long")).alias("n_known"),
        F.sum(F.coalesce("head.base", F.col("n") * F.col("base"))).alias("base"),
        F.sum(F.coalesce("head.lp", F.col("n") * F.col("lp"))).alias("lp"),
    )
    one = per.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    by_row = lambda c: (F.col(c) / F.col("rows"))
    return one.select(
        "id", "held_out", by_row("n_tokens").cast("long").alias("n_tokens"), by_row("n_known").cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"), by_row("base").alias("base_score"), by_row("lp").alias("score"))
