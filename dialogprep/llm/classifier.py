"""Quality classifier: a sparse ensemble of rules over text statistics.

1. Each text gets a fixed set of statistics (columns, one pass).
2. A small forest of shallow trees is fit on labelled rows; every path from a
   root to a node below it is a rule: a conjunction of bounds on statistics.
3. A logistic model with lasso penalty is fit on the rules' truth values; most
   weights become zero.
4. The rules that remain are compiled to one column expression, so scoring is
   a projection: no join, no shuffle, no Python.

Labelled rows: at most ``MAX_TRAIN`` of lowest hashed id, from rows whose hash
of the id does not hold them out.  Only the text is an input of a score.

Defined results: null text is empty and gets a score like any other; labels
that are null, or whose id has no document, are not used; with labels of one
class only, every score is that class; without labels every score is 1 (nothing
speaks against any text); repeated rows give repeated rows; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogprep.llm.common import id_crc, keep, text_of, words

MAX_TRAIN = 20_000
TREES = 16
DEPTH = 3
PENALTY = 0.001
SEED = 11
THRESHOLD = 0.7
HOLD_OUT, HELD = 4, 2

Bound = tuple[int, str, float]  # statistic, "<=" or ">", threshold

STATISTICS = ("log_words", "mean_word", "upper", "symbols", "bangs", "digits", "stops", "distinct", "dup_lines", "line_words", "non_ascii")


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with a struct column ``stats`` (doubles named as STATISTICS)."""
    t = F.col(text)

    def chars(other_than: str) -> Column:
        return F.length(F.regexp_replace(t, other_than, ""))

    d = df.withColumns({
        "_w": words(t), "_lines": F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), "_n": F.greatest(F.length(t), F.lit(1)),
        "_upper": chars(r"\P{Lu}+"), "_symbols": chars("[^#*$%&|<>]+"), "_bangs": chars("[^!]+"), "_digits": chars("[^0-9]+"), "_stops": chars("[^.,;:?]+"),
    })
    n_words = F.greatest(F.size("_w"), F.lit(1))
    n_lines = F.greatest(F.size("_lines"), F.lit(1))
    values = {
        "log_words": F.log1p(F.size("_w")), "mean_word": F.col("_n") / n_words, "upper": F.col("_upper") / F.col("_n"),
        "symbols": F.col("_symbols") / F.col("_n"), "bangs": F.col("_bangs") / F.col("_n"), "digits": F.col("_digits") / F.col("_n"),
        "stops": F.col("_stops") / F.col("_n"), "distinct": F.size(F.array_distinct("_w")) / n_words,
        "dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))) / n_lines, "line_words": F.size("_w") / n_lines,
        "non_ascii": (F.octet_length(t) - F.length(t)) / F.col("_n"),
    }
    stats = F.struct(*[values[s].cast("double").alias(s) for s in STATISTICS])
    return d.withColumn("stats", stats).drop("_w", "_lines", "_n", "_upper", "_symbols", "_bangs", "_digits", "_stops")


@dataclass(frozen=True)
class RuleModel:
    """Weighted rules; ``intercept`` alone if there are none."""

    intercept: float
    rules: Sequence[tuple[tuple[Bound, ...], float]] = field(default_factory=tuple)
    constant: float | None = None

    def score(self, stats: str = "stats") -> Column:
        """The score, 0 to 1, as one expression over the statistics."""
        if self.constant is not None:
            return F.lit(float(self.constant))
        z = F.lit(float(self.intercept))
        for bounds, weight in self.rules:
            z = z + F.when(condition(bounds, stats), F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def describe(self) -> list[str]:
        return [f"{w:+.3f} if " + " and ".join(f"{STATISTICS[i]} {op} {v:.4g}" for i, op, v in b) for b, w in self.rules]


def condition(bounds: Sequence[Bound], stats: str) -> Column:
    out = F.lit(True)
    for i, op, value in bounds:
        c = F.col(f"{stats}.{STATISTICS[i]}")
        out = out & (c <= value if op == "<=" else c > value)
    return out


def tree_paths(root) -> list[tuple[Bound, ...]]:
    """The conjunctions that lead to each node below the root; a later bound on
    the same side of a statistic replaces the earlier, looser one."""
    out = []
    todo = [(root, {})]
    while todo:
        node, bounds = todo.pop()
        if bounds:
            out.append(tuple((i, op, v) for (i, op), v in sorted(bounds.items())))
        if node.getClass().getSimpleName() == "InternalNode":
            i, v = node.split().featureIndex(), float(node.split().threshold())
            todo.append((node.leftChild(), bounds | {(i, "<="): v}))
            todo.append((node.rightChild(), bounds | {(i, ">"): v}))
    return out


def held_out(id_col: Column) -> Column:
    return F.pmod(id_crc(id_col), F.lit(HOLD_OUT)) == HELD


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_train: int) -> DataFrame:
    """Statistics and label of the training rows, at most ``max_train`` labels."""
    usable = labels.select(labels["doc_id"].alias("lid"), labels[label_col].cast("double").alias("label"))
    usable = usable.filter(F.col("label").isNotNull() & F.col("lid").isNotNull() & ~held_out(F.col("lid")))
    chosen = usable.orderBy(F.xxhash64("lid"), "lid", "label").limit(max_train)
    d = docs.select(docs[id_col].alias("lid"), text_of(docs[text_col]).alias("text"))
    found = d.join(F.broadcast(chosen), "lid")  # at most max_train short rows
    return with_statistics(found).select("lid", "label", "stats")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> RuleModel:
    rows = labelled(docs, labels, id_col, text_col, label_col, max_train).select("lid", "label", "stats.*")
    rows = keep(rows.repartition(4, "lid").sortWithinPartitions("lid", "label"))
    classes = sorted(r["label"] for r in rows.select("label").distinct().limit(3).collect())
    if len(classes) < 2:
        return RuleModel(0.0, (), classes[0] if classes else 1.0)
    data = VectorAssembler(inputCols=list(STATISTICS), outputCol="x").transform(rows).cache()
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, maxBins=64, seed=SEED,
                                    featureSubsetStrategy="onethird", subsamplingRate=0.7, minInstancesPerNode=5).fit(data)
    rules = sorted({p for tree in forest.trees for p in tree_paths(tree._java_obj.rootNode())})
    if not rules:
        data.unpersist()
        return RuleModel(0.0, (), float(data.agg(F.avg("label")).first()[0]))
    truth = rows.select("label", F.struct(*STATISTICS).alias("stats"))
    truth = truth.select("label", *[condition(b, "stats").cast("double").alias(f"r{k}") for k, b in enumerate(rules)])
    truth = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="x").transform(truth).select("label", "x").cache()
    model = LogisticRegression(featuresCol="x", labelCol="label", elasticNetParam=1.0, regParam=PENALTY, maxIter=60, standardization=False).fit(truth)
    data.unpersist()
    truth.unpersist()
    kept = [(b, float(w)) for b, w in zip(rules, model.coefficients.toArray()) if w != 0.0]
    return RuleModel(float(model.intercept), tuple(kept))


def classify(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id, held_out, score, predicted``."""
    d = docs.select(docs[id_col].alias("id"), held_out(docs[id_col]).alias("held_out"), text_of(docs[text_col]).alias("text"))
    d = with_statistics(d).select("id", "held_out", model.score().alias("score"))
    return d.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accept(docs: DataFrame, model: RuleModel, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows the model rejects, all their columns."""
    d = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), text_of(docs[text_col]).alias("text"))
    return with_statistics(d).filter(model.score() >= THRESHOLD).select("row.*")
