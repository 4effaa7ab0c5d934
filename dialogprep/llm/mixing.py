"""Mixing sources to target weights.

Tokens (words) are summed per source; each source's target is its weight's
share of all tokens, limited to ``max_rate`` times its own size, the excess
going to the others by weight until none is above its limit.  A document is
then emitted floor(rate) times, and once more if a uniform number hashed from
seed and id is at most its source's cut.

A cut at the rate's fraction would give every document its copy with that
probability, but a source of few, long documents would miss its target by far.
The cut is therefore the number, near the fraction, at which the documents in
the order of their numbers have used up what the source still lacks; the
document on the border is taken or not by a number hashed from the source, so
that a copy's probability stays the fraction.  A source misses its target by
less than one document (rows of one id draw one number and go together).

With limits ``c_i`` the targets are ``min(c_i, L * w_i)`` for the one ``L``
that spends all tokens.  In the order of ``c_i / w_i``, ``L`` is the largest
``(T - limits before) / (W - weights before)``: two global running sums over
the table of sources and one maximum, no loop.

Defined results: null text has no tokens; null is a source of its own, last in
order; sources without tokens get target 0 and rate 0; a null id hashes as the
empty text; equal ids draw equal numbers, so reruns agree; very long texts are
counted whole; an empty table gives no rows; other columns pass through :func:`mix` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogprep.llm.common import WORD, join_small, keep, running, text_of

# Weights of the sources in order, and the limit on repetition.
WEIGHTS = (5, 2, 1)
MAX_RATE = 3
SEED = "mix-1"


def n_words(col: Column) -> Column:
    return F.regexp_count(text_of(col), F.lit(WORD)).cast("long")


def source_rates(sized: DataFrame, weights=WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """``source, source_size, target, rate`` from rows of ``source, size``."""
    totals = keep(sized.groupBy("source").agg(F.sum("size").alias("source_size")))  # one row per source
    ranked = running(totals, [F.col("source").isNull().asc(), F.col("source").asc()], {})
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.pmod(F.col("_pos") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = keep(ranked.select("source", "source_size", F.col("_pos").alias("at"), w.cast("long").alias("w")))
    by_limit = [(F.col("source_size") / F.col("w")).asc(), F.col("at").asc()]
    before = running(ranked, by_limit, {"s0": "source_size", "w0": "w"})
    all_ = ranked.agg(F.sum("source_size").alias("all_size"), F.sum("w").alias("all_w"))
    level = before.crossJoin(F.broadcast(all_)).agg(  # one row of totals
        F.max((F.col("all_size") - max_rate * F.col("s0")).cast("double") / (F.col("all_w") - F.col("w0")).cast("double")).alias("level"))
    out = ranked.crossJoin(F.broadcast(level))  # one row
    target = F.least((max_rate * F.col("source_size")).cast("double"), F.col("level") * F.col("w"))
    out = out.withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_rate)))).otherwise(F.lit(0.0))
    return out.select("source", "source_size", "target", rate.alias("rate"))


def uniform(*parts: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) hashed from the seed and the parts (null as empty)."""
    h = F.md5(F.concat(F.lit(f"{seed}|"), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def with_cuts(sized: DataFrame, rates: DataFrame, seed: str = SEED) -> DataFrame:
    """``rates`` with each source's ``cut``: documents whose number is at most that get one more copy."""
    rates = keep(rates)
    rows = sized.select("source", "size", "id", uniform(sized["id"], seed=seed).alias("u"))
    order = [F.col("source").isNull().asc(), F.col("source").asc(), F.col("u").asc(), F.col("id").asc(), F.col("size").asc()]
    ranked = running(rows, order, {"before": "size"})
    ahead = running(rates, [F.col("source").isNull().asc(), F.col("source").asc()], {"ahead": "source_size"}).drop("_pos")
    ahead = ahead.withColumn("lacks", F.col("target") - F.floor("rate") * F.col("source_size"))
    ahead = ahead.withColumn("border", uniform(F.lit("source|"), F.col("source"), seed=seed)).select("source", "ahead", "lacks", "border")
    d = join_small(ranked, ahead.withColumnRenamed("source", "_source"), "_source", F.col("id"), left_key="source")
    taken = (F.col("before") - F.col("ahead") + F.col("size") * F.col("border")) < F.col("lacks")
    cuts = d.filter(taken).groupBy("source").agg(F.max("u").alias("cut")).withColumnRenamed("source", "_source")
    return rates.join(cuts, rates["source"].eqNullSafe(cuts["_source"]), "left").drop("_source")


def copies(rate: Column, cut: Column, id_col: Column, seed: str = SEED) -> Column:
    """floor(rate), and one more for numbers up to the source's cut."""
    return (F.floor(rate) + F.coalesce(uniform(id_col, seed=seed) <= cut, F.lit(False)).cast("long")).cast("long")


def mix_plan(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, max_rate=MAX_RATE, seed=SEED) -> DataFrame:
    """One row per document: ``id, source, size, source_size, target, rate, copies``."""
    sized = _sized(docs, id_col, text_col, source_col)
    rates = with_cuts(sized, source_rates(sized, weights, max_rate), seed)
    return join_small(sized, rates, "source", F.col("id")).withColumn("copies", copies(F.col("rate"), F.col("cut"), F.col("id"), seed)).drop("cut")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return keep(docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{source_col}`"].cast("string").alias("source"), n_words(docs[f"`{text_col}`"]).alias("size")))


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, max_rate=MAX_RATE, seed=SEED) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it."""
    sized = _sized(docs, id_col, text_col, source_col)
    rates = with_cuts(sized, source_rates(sized, weights, max_rate), seed).select("source", "rate", "cut")
    d = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs[id_col].alias("id"), docs[source_col].cast("string").alias("source"))
    d = join_small(d, rates, "source", F.col("id")).withColumn("copies", copies(F.col("rate"), F.col("cut"), F.col("id"), seed))
    d = d.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return d.select("row.*")
