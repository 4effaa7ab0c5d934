"""Quality rules: distribution divergence from language references.

A document's character-class histogram and its common-word histogram are
compared with its language's references, which are the pooled histograms of
all documents of that language that pass the base rules, by Jensen-Shannon
distance.  A document is rejected if a distance is above its limit; a histogram
counts only from a least length on, so short clean texts stay.

Base rules: fewer than 10 words, or more than a fifth of the words in five-word
windows that occur twice or more.

Everything is columns; windows are compared by 64-bit hashes of their words'
hashes (chance of a false match about 1e-10 for a text of 20,000 words).

Defined results: null text has no words (base_failed); a null language is
compared with the pooled histogram of all documents; where a language has no
reference the verdict follows the base rules; repeated rows give repeated
rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogprep.llm.common import SPACE_CLASS, WORD, join_small, keep, text_of

# The most common words of four languages.
COMMON_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "with", "on", "as", "be",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "ist", "dem", "auf",
    "de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "est",
    "el", "y", "los", "se", "del", "las", "por", "con", "para",
)
# Character classes; what is left over is a class of its own.
CHAR_CLASSES = ("[^a-z]+", "[^A-Z]+", "[^0-9]+", r"[^\x20\x09-\x0D]+", "[^.,;:'\"()?-]+", "[^#*$%&|<>!=+{}_~^@/\\\\\\[\\]]+", r"[^\x{80}-\x{10FFFF}]+")
SYMBOLS = "[^#*$%&|<>]+"
# Limits between labelled clean and poor texts: clean texts of 200 words or more
# stay under 0.20 by words (shorter ones scatter up to 0.35, hence the guard), and
# of 200 characters or more under 0.31 by characters.
MAX_CHAR_DISTANCE = 0.31
MAX_WORD_DISTANCE = 0.23
MIN_CHARS = 200
MIN_WORDS = 200


def _features(docs: DataFrame, id_col: str, text_col: str, lang_col: str | None) -> DataFrame:
    """Counts of one pass over the texts; narrow, without the text."""
    lang = docs[lang_col].cast("string") if lang_col else F.lit(None).cast("string")
    d = docs.select(docs[id_col].alias("id"), lang.alias("lang"), text_of(docs[text_col]).alias("t"))
    left = [F.length(F.regexp_replace("t", c, "")).cast("long") for c in CHAR_CLASSES]
    d = d.select(
        "id", "lang", "t", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("w"),
        F.array(*left).alias("classes"), F.length("t").cast("long").alias("n_chars"),
        F.length(F.regexp_replace("t", SYMBOLS, "")).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    d = d.select(
        "id", "lang", "classes", "n_chars", "n_symbols", F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
        F.array_join(F.filter(F.split(F.lower("t"), rf"[{SPACE_CLASS}]+", -1), lambda x: x.isin(*COMMON_WORDS)), "  ").alias("common"),
    )
    window = F.transform(F.sequence(F.lit(1), F.size("h") - 4), lambda i: F.xxhash64(
        F.get("h", i - 1), F.get("h", i), F.get("h", i + 1), F.get("h", i + 2), F.get("h", i + 3)))
    d = d.withColumn("win", F.when(F.size("h") >= 5, window).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("common", F.concat(F.lit(" "), "common", F.lit(" ")))
    hits = [((F.length("common") - F.length(F.replace("common", F.lit(f" {c} "), F.lit("")))) / (len(c) + 2)).cast("long") for c in COMMON_WORDS]
    repeats = F.size(F.array_distinct("win")) < F.size("win")
    return d.select(
        "id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_chars", "classes", F.array(*hits).alias("hits"),
        F.when(repeats, _covered(F.col("win"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _covered(win: Column) -> Column:
    """Words covered by windows whose value occurs twice or more."""
    return F.size(F.array_distinct(F.flatten(F.transform(_repeated_starts(win), lambda i: F.sequence(i, i + 4)))))


def _repeated_starts(win: Column) -> Column:
    """Starts of the windows that occur more than once: sorted by value, equal
    values are neighbours."""
    at = F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # One struct of the sorted array, so that it is sorted once for all lookups.
    return F.flatten(F.transform(F.array(F.struct(at.alias("s"))), lambda o: F.transform(
        F.filter(F.transform(o["s"], lambda x, k: F.struct(
            x["i"].alias("i"),
            (F.get(o["s"], k - 1)["h"].eqNullSafe(x["h"]) | F.get(o["s"], k + 1)["h"].eqNullSafe(x["h"])).alias("twice"))),
            lambda y: y["twice"]), lambda y: y["i"])))


def _with_rest(counts: Column, total: Column) -> Column:
    rest = F.greatest(total - F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    return F.concat(counts, F.array(rest))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two count arrays; null if one is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))

    def term(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))

    def both(x: Column, y: Column) -> Column:
        m = (x + y) / 2
        return (term(x, m) + term(y, m)) / 2

    boxed = F.array(F.struct(p.alias("p"), q.alias("q"), total(p).alias("a"), total(q).alias("b")))
    sums = F.transform(boxed, lambda o: F.when((o["a"] > 0) & (o["b"] > 0), F.sqrt(F.greatest(F.lit(0.0), F.aggregate(
        F.zip_with(o["p"], o["q"], lambda x, y: both(x / o["a"], y / o["b"])), F.lit(0.0), lambda s, x: s + x)))))
    return F.get(sums, F.lit(0))


def rate_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang",
                   max_char_distance: float = MAX_CHAR_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE,
                   min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: ``id``, the base counts, both distances, ``kept``."""
    f = _features(docs, id_col, text_col, lang_col)
    f = f.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    f = keep(f.withColumns({"classes": _with_rest(F.col("classes"), F.col("n_chars")), "hits": _with_rest(F.col("hits"), F.col("n_words"))}))
    k, m = len(CHAR_CLASSES) + 1, len(COMMON_WORDS) + 1
    pools = [F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(k)] + [F.sum(F.get("hits", F.lit(i))).alias(f"h{i}") for i in range(m)]
    by_lang = f.filter("not base_failed").groupBy("lang").agg(*pools)
    arrays = [F.array(*[f"c{i}" for i in range(k)]).alias("ref_c"), F.array(*[f"h{i}" for i in range(m)]).alias("ref_h")]
    everything = by_lang.agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(k)], *[F.sum(f"h{i}").alias(f"h{i}") for i in range(m)])
    refs = keep(by_lang.filter("lang is not null").select("lang", *arrays).unionByName(everything.select(F.lit(None).cast("string").alias("lang"), *arrays)))
    d = join_small(f, refs, "lang", F.col("id"))
    d = d.withColumns({
        "char_distance": F.when(F.col("n_chars") >= min_chars, js_distance(F.col("classes"), F.col("ref_c"))),
        "word_distance": F.when(F.col("n_words") >= min_words, js_distance(F.col("hits"), F.col("ref_h"))),
    })
    far = (F.coalesce("char_distance", F.lit(0.0)) > max_char_distance) | (F.coalesce("word_distance", F.lit(0.0)) > max_word_distance)
    return d.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & ~far).alias("kept"), "char_distance", "word_distance")
