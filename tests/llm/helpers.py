"""Small tables and plain-Python restatements for the operator tests."""

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")

# Nulls in any column, empty and blank texts, ties, repeated rows, a long text.
HARD = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "a", 66),
    (2, "alpha BETA gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "b", 66),
    (2, "alpha BETA gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "b", 66),
    (3, None, None, None, None),
    (4, "", "en", None, 0),
    (None, "alpha beta", "en", "a", 10),
    (None, "alpha beta", "en", "a", 10),
    (5, " \t\n ", "de", "c", 4),
    (6, "É é ß \u2003 x\u00a0y 中文 \U0001F600 z", "fr", "a", 20),
    (7, "one two three four five\n" * 40, "en", "", 960),
    (8, "word " * 20000, "en", "a", 100000),
    (9, "x" * 30000, None, "c", 30000),
]


def docs(spark, rows=HARD):
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """More columns, with names that the operators use themselves."""
    from pyspark.sql import functions as F

    names = ("id", "norm", "digest", "salt", "row", "size", "rate", "copies", "node", "h", "stats", "_w", "text_sha256", "kept", "word", "w.x")
    return df.withColumns({n: F.lit(i) for i, n in enumerate(names)})


def words(text):
    return SPACE.findall(text or "")
