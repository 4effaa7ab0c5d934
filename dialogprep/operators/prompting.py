"""Prompt modes (B14), fixed one-shot (B10/E2) and dynamic few-shot.

The mode is a plan-time choice (the config is constant), so each mode builds
its own projection instead of a per-row CASE.  The few-shot pool is reduced to
its budget-bounded prefix and shipped to every task as a scalar subquery, so
no example is ever paired with pool rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialogprep.functions import prompts as P
from dialogprep.operators.ordinal import ordered_index
from dialogprep.schema import PromptConfig, PromptText



def _conv() -> Column:
    return F.col("input.conversation")


def _kw() -> Column:
    return F.col("input.subject_keyword")


# -- few-shot pool -----------------------------------------------------------
# Rows per bucket of the pool's running total (``pos`` is unique, so a bucket
# ``pos div POOL_BUCKET_ROWS`` never holds more rows than this).
POOL_BUCKET_ROWS = 4096


def few_shot_budget(pool: DataFrame, tokenizer, specials_per_encode: int = 1) -> DataFrame:
    """G1: (pos, text, n_tokens, cum_tokens) - running token total in pool order.

    Each text costs its token count plus ``specials_per_encode``.  Costs are
    non-negative, so ``cum_tokens`` is monotone (the few-shot rule relies on it).
    ``pos`` is the pool's unique position, so arithmetic buckets bound every
    window without a quantile pass.
    """
    costed = pool.select("pos", "text",
                         (tokenizer.n_tokens(F.col("text")) + F.lit(specials_per_encode))
                         .cast("long").alias("n_tokens"))
    return ordered_index(costed, ["pos"], F.floor(F.col("pos") / POOL_BUCKET_ROWS).cast("long"),
                         rank_col=None, value=F.col("n_tokens"), running_col="cum_tokens")


def few_shot_prefix(pool: DataFrame, tokenizer, block_size: int, specials_per_encode: int = 1,
                    text: PromptText = PromptText()) -> Column:
    """E1 build side: the affordable pool prefix as a direct-address table (scalar subquery).

    ``fits[r]`` is the number of examples that fit into a remaining budget of
    ``r`` tokens (0 .. ``block_size``), ``ends[k]`` the length of the first ``k``
    examples' text, and ``text`` all of it, each entry wrapped as
    ``[Example i]\\n{text}{separator}``; the example number is ``pos + 1`` because the
    kept rows are always a prefix.  So a row's examples are two array accesses
    and one substring, whatever the pool.

    Only entries with ``cum_tokens <= block_size`` can ever be chosen, so the
    text holds at most ``block_size`` tokens (and its wrappers) whatever the pool size.
    """
    if specials_per_encode < 1:
        raise ValueError("specials_per_encode must be at least 1: entries without cost would not bound the prefix")
    head, _, tail = text.example_header.partition("{i}")
    # Every entry costs a token or more, so positions from block_size on cannot fit.
    reachable = pool.filter(F.col("pos") < block_size)
    budget = few_shot_budget(reachable, tokenizer, specials_per_encode).filter(F.col("cum_tokens") <= block_size)
    piece = F.concat(F.lit(head), (F.col("pos") + 1).cast("string"), F.lit(tail),
                     F.coalesce(F.col("text"), F.lit("")), F.lit(text.example_separator))
    pieces = budget.select("pos", "cum_tokens", piece.alias("piece"))
    # At most block_size rows, so this window is small whatever the pool.
    pieces = pieces.withColumn("end", F.sum(F.length("piece")).over(Window.orderBy("pos")))
    entries = pieces.agg(F.array_sort(F.collect_list(F.struct("pos", F.col("cum_tokens").alias("cum"), "end", "piece"))).alias("e"))
    # A budget from one entry's total up to the next one's fits the same number of examples.
    upto = F.concat(F.transform("e", lambda x: x["cum"]), F.array(F.lit(block_size + 1).cast("long")))
    entries = entries.withColumn("upto", upto)
    runs = F.transform("upto", lambda t, k: F.array_repeat(k, (t - F.when(k == 0, F.lit(0)).otherwise(F.get("upto", k - 1))).cast("int")))
    return entries.select(F.struct(
        F.flatten(runs).alias("fits"),
        F.concat(F.array(F.lit(0).cast("long")), F.transform("e", lambda x: x["end"])).alias("ends"),
        F.array_join(F.transform("e", lambda x: x["piece"]), "").alias("text")).alias("pool")).scalar()


def dynamic_few_shot(df: DataFrame, pool: DataFrame, tokenizer, cfg: PromptConfig) -> DataFrame:
    """Add ``base_tokens``, ``n_examples`` and ``fewshot_prefix``.

    ``base`` = tokens of the rendered example-free prompt (generation prompt
    included) + ``specials_per_encode``.  Kept examples = the longest pool
    prefix with ``base + cum <= block`` (greedy stop at the first misfit, valid
    because costs are non-negative).  Wrapper text is not counted.
    """
    t = cfg.text
    table = few_shot_prefix(pool, tokenizer, cfg.fewshot_block_size, cfg.specials_per_encode, t)
    rendered = P.render_chat(P.messages(P.system_prompt(t), P.summary_prompt(_conv(), _kw(), t)),
                             cfg.template, generation_prompt=True)
    base = tokenizer.n_tokens(rendered) + F.lit(cfg.specials_per_encode)
    out = df.withColumn("base_tokens", base.cast("long")).withColumn("_fs", table)
    left = (F.lit(cfg.fewshot_block_size) - F.col("base_tokens")).cast("int")
    out = out.withColumn("n_examples", F.when(left < 0, F.lit(0)).otherwise(F.get(F.col("_fs.fits"), left)).cast("int"))
    prefix = F.substr(F.col("_fs.text"), F.lit(1), F.get(F.col("_fs.ends"), F.col("n_examples")).cast("int"))
    return out.withColumn("fewshot_prefix", prefix).drop("_fs")


# -- one-shot ------------------------------------------------------------------
def one_shot_example(pool: DataFrame | None, idx: int, text: PromptText = PromptText()) -> Column:
    """The worked example for index ``idx``.

    0 is the built-in example; any other index selects the pool row at that
    position, negative indexes counting from the end.  Out of range fails.
    """
    if idx == 0:
        return F.lit(text.one_shot_example)
    if pool is None:
        raise ValueError("a pool is required for a non-zero one-shot index")
    if idx > 0:
        target = F.lit(idx)
    else:
        target = pool.agg(F.count(F.lit(1))).scalar() + F.lit(idx)
    found = pool.filter(F.col("pos") == target).agg(F.max("text")).scalar()
    return F.when(found.isNull(), F.raise_error(F.lit(f"one-shot index {idx} out of range"))
                  ).otherwise(found)


# -- mode dispatch -------------------------------------------------------------
_PROMPT_COLS = ("task", "mode", "messages", "source_text", "target_text", "copy_labels")


def _chat_row(system: Column, user: Column, target: Column, cfg: PromptConfig, task: str,
              mode: str, generation_prompt: bool = True, copy_labels: bool = False) -> Column:
    return F.struct(
        F.lit(task).alias("task"),
        F.lit(mode).alias("mode"),
        P.messages(system, user).alias("messages"),
        F.lit(None).cast("string").alias("raw_text"),
        F.lit(generation_prompt).alias("generation_prompt"),
        target.alias("target_text"),
        F.lit(copy_labels).alias("copy_labels"),
    )


def primary_prompt(df: DataFrame, cfg: PromptConfig, pool: DataFrame | None = None,
                   tokenizer=None) -> tuple[DataFrame, Column]:
    """The prompt struct of the configured mode (B14); returns (df, struct)."""
    t = cfg.text
    output = F.coalesce(F.col("output"), F.lit(""))
    mode = cfg.mode
    if mode == "tapt":
        row = _chat_row(P.domain_system_prompt(_kw(), t), P.transcript(_conv(), t), F.lit(""), cfg,
                        "summary", mode, generation_prompt=False, copy_labels=True)
    elif mode == "instruction":
        prompt = P.instruction_prompt(_conv(), _kw(), t)
        row = F.struct(
            F.lit("summary").alias("task"), F.lit(mode).alias("mode"),
            P.messages(None, F.lit("")).alias("messages"), prompt.alias("raw_text"),
            F.lit(False).alias("generation_prompt"),
            output.alias("target_text"), F.lit(False).alias("copy_labels"),
        )
    elif mode == "one_shot":
        system = P.one_shot_system(one_shot_example(pool, cfg.oneshot_idx, t), t)
        row = _chat_row(system, P.summary_prompt(_conv(), _kw(), t), output, cfg, "summary", mode)
    elif mode == "few_shot":
        if pool is None or tokenizer is None:
            raise ValueError("few-shot mode needs a pool and a tokenizer")
        df = dynamic_few_shot(df, pool, tokenizer, cfg)
        system = F.concat(F.col("fewshot_prefix"), P.system_prompt(t))
        row = _chat_row(system, P.summary_prompt(_conv(), _kw(), t), output, cfg, "summary", mode)
    else:
        row = _chat_row(P.system_prompt(t), P.summary_prompt(_conv(), _kw(), t), output, cfg, "summary", mode)
    return df, row


def topic_prompt_row(cfg: PromptConfig) -> Column:
    """The topic-extraction example of a record (target = joined keywords)."""
    t = cfg.text
    return _chat_row(P.system_prompt(t), P.topic_prompt(_conv(), t), P.keywords_text(_kw(), t), cfg,
                     "topic", cfg.mode)


def build_prompts(df: DataFrame, cfg: PromptConfig, pool: DataFrame | None = None,
                  tokenizer=None) -> DataFrame:
    """B14 (+ I2): add task, mode, messages, source_text, target_text, copy_labels.

    With ``multitask`` every record yields its primary row and a topic row in a
    single scan (``explode`` of a two-element array); ``task_order`` (0 primary,
    1 topic) keeps the reference's "primary rows first" order available.  The
    chat template is applied once, after the explode, to the message column.
    Instruction mode bypasses the template: its single user message holds the
    whole prompt, which is also the source text.
    """
    df, row = primary_prompt(df, cfg, pool, tokenizer)
    rows = [row]
    if cfg.multitask:
        rows.append(topic_prompt_row(cfg))
    keep = [c for c in df.columns if c not in _PROMPT_COLS]
    exploded = df.select(*keep, F.posexplode(F.array(*rows)).alias("task_order", "_p"))
    flat = exploded.select(*keep, "task_order", "_p.*")
    rendered = F.concat(P.render_chat(F.col("messages"), cfg.template, generation_prompt=False),
                        F.when(F.col("generation_prompt"), F.lit(cfg.template.generation_prompt))
                        .otherwise(F.lit("")))
    flat = flat.withColumn("source_text", F.coalesce(F.col("raw_text"), rendered))
    flat = flat.withColumn(
        "messages",
        F.when(F.col("raw_text").isNull(), F.col("messages")).otherwise(
            P.messages(None, F.col("raw_text"))),
    )
    return flat.select(*keep, "task_order", *_PROMPT_COLS)
