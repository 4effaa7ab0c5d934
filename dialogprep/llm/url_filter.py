"""URL filters: a sort-merge range join with a sorted sweep.

A rule is a host and a path prefix.  Its canonical key is the reversed host
(``org.example``), U+0001, and the path, so the urls it fits are those one of
whose keys (one for each suffix of the host, as deep as the deepest rule)
begins with the rule's key: the interval from the key up to its last
extension.  Such intervals nest or are apart.

Rules and url keys are sorted together over range partitions.  Each rule
carries the stack of rules open at its start (itself and those that enclose
it); for a url key, the last rule at or before it gives that stack, and the
deepest member that still encloses the key is its rule.  A range begins with
the stack of the last rule in the ranges before it (one row per range).  Equal
keys, of a hot host, say, are dealt over ranges by a hash of the row's id.

Defined results: a null url or one without ``://`` has host and path empty and
fits no rule; the longest rule string wins, then the longer host; no rule:
``default``; repeated pages give repeated rows; without rules every page gets
the default; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialogprep.llm.common import LOWER, UPPER, keep

SEP = "\u0001"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _key(host: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(SEP), path)


def rule_stacks(rules: DataFrame) -> DataFrame:
    """``key, stack``: for each rule key the rules open there, outermost first.

    A rule's ancestors are the rules whose key is a prefix of its own: each
    rule lists its prefixes and joins them with the rules by equality.
    """
    r = rules.select(_key(F.col("host"), F.col("path")).alias("key"), F.concat("host", "path").alias("rule"),
                     F.length("host").alias("host_len"), F.col("verdict"))
    r = r.groupBy("key").agg(F.min(F.struct("rule", "host_len", "verdict")).alias("v"))
    prefixes = r.select(F.col("key").alias("at"), F.explode(
        F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.substr(F.col("key"), F.lit(1), n))).alias("p"))
    open_ = prefixes.join(r, prefixes["p"] == r["key"])
    stack = F.sort_array(F.collect_list(F.struct(F.length("key").alias("len"), F.col("key").alias("key"), F.col("v").alias("v"))))
    return open_.groupBy("at").agg(stack.alias("stack")).withColumnRenamed("at", "key")


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow", rows_per_range: int = 500_000) -> DataFrame:
    """One row per page: ``id, host, path, rule, verdict``."""
    depth = rules.agg(F.max(F.size(F.split("host", r"\.", -1)))).first()[0] or 1
    p = pages.select(pages[id_col].alias("id"), host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path"))
    labels = F.reverse(F.split("host", r"\.", -1))
    level = F.explode(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(depth))))
    keys = p.select("id", "host", "path", labels.alias("labels"), level.alias("level"))
    keys = keys.select("id", "host", "path", "level", F.concat(
        F.array_join(F.slice("labels", F.lit(1), F.col("level")), "."), F.lit(SEP), F.col("path")).alias("key"))

    stacks = rule_stacks(rules)
    kind = stacks.schema["stack"].dataType
    events = keys.withColumns({"stack": F.lit(None).cast(kind), "kind": F.lit(1), "deal": F.xxhash64("id")}).unionByName(
        stacks.withColumns({"kind": F.lit(0), "deal": F.lit(0).cast("long")}), allowMissingColumns=True)
    n = max(2, math.ceil(pages.count() * depth / rows_per_range))
    ranged = keep(events.repartitionByRange(n, "key", "kind", "deal").withColumn("at", F.spark_partition_id()))
    last = ranged.filter("kind = 0").groupBy("at").agg(F.max_by("stack", "key").alias("tail"))
    ranges = ranged.sparkSession.range(n).select(F.col("id").cast("int").alias("at"))
    before = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    opened = ranges.join(last, "at", "left").select("at", F.last("tail", ignorenulls=True).over(before).alias("carry"))
    sweep = Window.partitionBy("at").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = ranged.withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).filter("kind = 1").join(opened, "at", "left")
    hits = F.filter(F.coalesce("open", "carry"), lambda s: F.startswith(F.col("key"), s["key"]))
    best = F.when(F.size(hits) > 0, F.element_at(hits, -1)["v"])
    rated = swept.select("id", "host", "path", "level", best.alias("v"))
    rated = rated.withColumn("v", F.when(F.col("v").isNotNull(), F.struct(
        F.length("v.rule").alias("len"), F.col("v.host_len").alias("host_len"), F.col("v.rule").alias("rule"), F.col("v.verdict").alias("verdict"))))
    one = rated.groupBy("id", "host", "path").agg(F.max("v").alias("v"), F.sum((F.col("level") == 1).cast("long")).alias("n"))
    return one.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select(
        "id", "host", "path", F.col("v.rule").alias("rule"), F.coalesce("v.verdict", F.lit(default)).alias("verdict"))
