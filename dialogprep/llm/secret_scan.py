"""Secret scans: fixed patterns, and character Markov models.

Pattern spans are leftmost non-overlapping matches, found with built-in
functions: ``regexp_extract_all`` gives the matches, ``split`` the gaps between
them, and running sums of their lengths the offsets in code points.

The method adds spans of kind ``markov``: tokens of ``[A-Za-z0-9+/_=-]`` of 20
or more characters that overlap no pattern span and whose log-likelihood ratio
per character, random string against ordinary identifier, is above a limit.
First-order Markov models count character pairs of labelled samples:

* random strings of four alphabets (hex, base64, upper case with digits, lower
  case with digits), ``RANDOM_STRINGS`` of each, made from hashes of numbers;
* ordinary words: the parts ``[A-Za-z0-9]+`` under 20 characters of all
  documents, outside assignments (whose values are labelled by their keyword).
  From the words' counts follow those of the identifiers made of them: words
  joined by ``_``, ``-``, ``/``, ``+`` or ``=``, by a capital, or numbered, as
  written and in upper case; numbers and ruled lines are ordinary as well.

The best model of either side counts.  A model has at most 68 * 68 pairs,
whatever the input.

Defined results: null text is empty; an empty text has no spans; repeated rows
give repeated rows; an empty table gives no rows and trains nothing; without
training words the method adds no spans; other columns are not read.  A long
text is scanned whole, in time proportional to its length but for the running
sums, which take the number of its matches to the power of 4/3.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogprep.llm.common import text_of

# The base patterns; (kind, pattern, measured group, least length).
ASSIGN = (r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
          r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KINDS = (("assign", ASSIGN, 2, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32))
# The same matches, as a quick test whether there can be one at all.
QUICK = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{12}", "hex": r"[0-9a-f]{32}"}
# Runs under the least length never pass and touch no other run, so they need not be listed.
LISTED = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]{32,}+"}
HIDDEN = "\x01"  # stands for each character of an assignment
TOKEN = r"[A-Za-z0-9+/_=\x01-]{20,}+"
RANDOM_STRINGS = 2000
MIN_RATIO = 1.2
SMOOTH = 0.5
BACK_OFF = 10.0
OTHER = "~"
JOINS = "+/_=-"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" + JOINS + OTHER
# Shares of the words' ends and begins that an identifier's joins take.
JOIN_SHARE = {"_": 0.1, "-": 0.1, "/": 0.1, "+": 0.01, "=": 0.01}
CAMEL_SHARE, NUMBER_SHARE = 0.1, 0.1
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with ``value`` computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _running(steps: Column, rank: int, kind: str, passes: Callable[[Column], Column]) -> Column:
    """Spans of the matches that pass, from ``(gap, len, ...)`` of all in order.

    Appending to one list copies it for each match, so the matches are taken in
    blocks: short lists inside a block, and one list of the blocks' offsets.
    """
    empty = F.array().cast(SPAN)

    def add(a, m):
        s = a["at"] + m["gap"]
        e = s + m["len"]
        one = F.struct(s.alias("start"), F.lit(rank).alias("rank"), e.alias("end"), F.lit(kind).alias("kind"))
        return F.struct(e.alias("at"), F.when(passes(m), F.concat(a["out"], F.array(one))).otherwise(a["out"]).alias("out"))

    def blocks(m):
        width = F.greatest(F.lit(1), F.ceil(F.cbrt(F.size(m))).cast("int"))
        last = F.floor(F.greatest(F.lit(0), F.size(m) - 1) / width).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(m, b * width + 1, width))

    def offset(a, block):
        total = F.aggregate(block, F.lit(0), lambda n, m: n + m["gap"] + m["len"])
        return F.struct((a["at"] + total).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))

    def whole(bs):
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        offsets = F.aggregate(bs, none, offset, lambda a: a["out"])
        inside = lambda b, at: F.aggregate(b, F.struct(at.alias("at"), empty.alias("out")), add, lambda a: a["out"])
        return F.flatten(F.zip_with(bs, offsets, inside))

    return _let(_let(steps, blocks), whole)


def spans(text: Column, pattern: str, kind: str, rank: int, group: int, passes: Callable[[Column], Column]) -> Column:
    """Spans of the pattern's matches that pass: a condition on a match's ``text`` (its ``group``)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    both = F.zip_with(found, sized, lambda m, g: F.struct(F.length(m).alias("len"), g.alias("text")))
    gaps = F.split(text, pattern, -1)  # one more than the matches
    steps = F.zip_with(both, gaps, lambda m, g: F.struct(F.length(g).alias("gap"), m["len"].alias("len"), m["text"].alias("text")))
    return _running(F.filter(steps, lambda m: m["len"].isNotNull()), rank, kind, passes)


def base_spans(text: Column) -> Column:
    """All pattern spans, by start and then kind as listed."""
    none = F.array().cast(SPAN)
    each = [F.when(text.rlike(QUICK[k]), spans(text, LISTED[k], k, i, g, lambda m, n=n: F.length(m["text"]) >= n)).otherwise(none) for i, (k, _, g, n) in enumerate(KINDS)]
    return F.sort_array(F.concat(*each))


def _hide(text: Column) -> Column:
    """The text with every character of a kept assignment as ``HIDDEN``."""
    _, pattern, group, least = KINDS[0]
    found, value = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))
    shown = F.zip_with(found, value, lambda m, v: F.when(F.length(v) >= least, F.repeat(F.lit(HIDDEN), F.length(m))).otherwise(m))
    parts = F.zip_with(F.split(text, pattern, -1), shown, lambda g, m: F.concat(g, F.coalesce(m, F.lit(""))))
    return F.when(text.rlike(pattern), F.array_join(parts, "")).otherwise(text)


def _pairs(strings: DataFrame) -> DataFrame:
    """``label, pair, n``: neighbouring characters in column ``s``, met ``n`` times; ``~`` is its begin and end."""
    chars = F.filter(F.split(F.concat(F.lit(OTHER), "s", F.lit(OTHER)), ""), lambda c: c != "")
    both = _let(chars, lambda c: F.zip_with(c, F.slice(c, F.lit(2), F.size(c)), lambda a, b: F.concat(a, b)))
    pairs = strings.select("label", "n", F.explode(both).alias("pair")).filter(F.col("pair").isNotNull())
    return pairs.groupBy("label", "pair").agg(F.sum("n").alias("n"))


def _identifiers(words: np.ndarray) -> np.ndarray:
    """Pair counts of identifiers made of the words whose pair counts are given."""
    at = {c: k for k, c in enumerate(ALPHABET)}
    end, begin = words[:, at[OTHER]].copy(), words[at[OTHER]].copy()
    out, n = words.copy(), max(begin.sum(), 1.0)
    for join, share in JOIN_SHARE.items():
        out[:, at[join]] += share * end
        out[at[join]] += share * begin
        out[at[join], at[join]] += share * n  # ruled lines
    capital = np.zeros_like(begin)
    for c in ALPHABET[:26]:
        capital[at[c]] = begin[at[c]] + begin[at[c.lower()]]
    out += CAMEL_SHARE * np.outer(end, capital) / n
    digits = [at[d] for d in "0123456789"]
    for d in digits:
        out[:, d] += NUMBER_SHARE / 10 * end
        out[d, digits] += NUMBER_SHARE / 10 * n / 10  # as many digits go on as end
        for last, share in {OTHER: 1.0, **JOIN_SHARE}.items():
            out[d, at[last]] += NUMBER_SHARE / 10 * share * n
    return out


def _upper(words: np.ndarray) -> np.ndarray:
    """The same words in upper case."""
    fold = np.eye(len(ALPHABET))
    for k, c in enumerate(ALPHABET):
        if c.islower():
            fold[k] = fold[ALPHABET.index(c.upper())]
    return fold.T @ words @ fold


def _logs(counts: np.ndarray) -> np.ndarray:
    """log P(next | char); pairs back off to how common the second character is."""
    single = counts.sum(0) + SMOOTH
    return np.log((counts + BACK_OFF * single / single.sum()) / (counts.sum(1, keepdims=True) + BACK_OFF))


def train_markov(docs: DataFrame, text_col: str = "text", random_strings: int = RANDOM_STRINGS) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Tables of log P(next | char) by places in ``ALPHABET``: random strings, ordinary identifiers."""
    shown = _hide(F.replace(text_of(docs[text_col]), F.lit(HIDDEN), F.lit(" ")))
    # Equal words are summed where they are read, before they move and before they are taken apart.
    words = docs.select(F.explode(F.split(shown, r"(?:[^A-Za-z0-9]++|(?<![A-Za-z0-9])[A-Za-z0-9]{20,}+)++")).alias("s")).filter("s != ''")
    words = words.groupBy("s").agg(F.count(F.lit(1)).alias("n")).withColumn("label", F.lit("word"))
    seed = lambda tag: F.sha2(F.concat(F.lit(tag), F.col("id").cast("string")), 256)
    b64 = lambda tag: F.base64(F.unhex(seed(tag)))
    plain = lambda tag: F.translate(b64(tag), "+/=", "xyz")
    made = {"hex": seed("a"), "base64": F.concat(plain("b"), b64("c")), "upper": F.upper(plain("d")), "lower": F.lower(plain("e"))}
    numbers = docs.sparkSession.range(random_strings)
    pairs = _pairs(words)
    for label, text in made.items():
        pairs = pairs.unionByName(_pairs(numbers.select(F.lit(label).alias("label"), text.alias("s"), F.lit(1).cast("long").alias("n"))))
    counts = {k: np.zeros((len(ALPHABET), len(ALPHABET))) for k in ("word", *made)}
    for r in pairs.collect():  # at most 5 * 68 * 68 rows
        counts[r["label"]][ALPHABET.index(r["pair"][0]), ALPHABET.index(r["pair"][1])] = r["n"]
    if not counts["word"].any():
        return [], []
    written = [_identifiers(w) for w in (counts["word"], _upper(counts["word"]))]
    return [_logs(counts[k]) for k in made], [_logs(w) for w in written]


def log_ratio(token: Column, models: tuple[list[np.ndarray], list[np.ndarray]]) -> Column:
    """Mean log-likelihood ratio per character pair, by the best model of either side."""
    n, (likely, ordinary) = len(ALPHABET), models
    tables = [F.lit(m.ravel()) for m in (*likely, *ordinary)]
    names = [f"s{k}" for k in range(len(tables))]
    chars = F.filter(F.split(F.concat(token, F.lit(OTHER)), ""), lambda c: c != "")
    start = F.struct(F.lit(n - 1).alias("last"), *[F.lit(0.0).alias(s) for s in names])

    def step(a, c):
        at = F.instr(F.lit(ALPHABET), c) - 1
        return F.struct(at.alias("last"), *[(a[s] + F.get(t, a["last"] * n + at)).alias(s) for s, t in zip(names, tables)])

    best = lambda a, some: F.greatest(*[a[s] for s in some])
    k = len(likely)
    return F.aggregate(chars, start, step, lambda a: best(a, names[:k]) - best(a, names[k:])) / (F.length(token) + 1)


def markov_spans(text: Column, models: tuple[list[np.ndarray], list[np.ndarray]], min_ratio: float = MIN_RATIO) -> Column:
    """Spans of tokens that look random and overlap no pattern span.

    An assignment's characters are hidden, and a token that holds any of them
    falls out.  Spans of the other kinds lie inside one token, which shows them.
    """
    none = F.array().cast(SPAN)
    if not models[0]:
        return none

    def random(m):
        tok = m["text"]
        known = F.contains(tok, F.lit(HIDDEN)) | tok.rlike(QUICK["access"]) | tok.rlike(QUICK["hex"])
        return F.when(known, F.lit(False)).otherwise(log_ratio(tok, models) > min_ratio)

    hidden = _hide(F.replace(text, F.lit(HIDDEN), F.lit(" ")))
    found = _let(hidden, lambda t: spans(t, TOKEN, "markov", len(KINDS), 0, random))
    return F.when(text.rlike(r"[A-Za-z0-9+/_=-]{20}"), found).otherwise(none)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_ratio: float = MIN_RATIO) -> DataFrame:
    """One row per document: ``id, text, base, spans``; both arrays of
    (start, rank, end, kind) in order, offsets in code points, end exclusive."""
    models = train_markov(docs, text_col)
    d = docs.select(docs[id_col].alias("id"), text_of(docs[text_col]).alias("text"))
    d = d.withColumn("base", base_spans(F.col("text")))
    return d.withColumn("spans", F.sort_array(F.concat("base", markov_spans(F.col("text"), models, min_ratio))))


def span_list(col: Column) -> Column:
    return F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
