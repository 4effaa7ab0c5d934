"""Registered checks: one Spark query per operator, each over the whole tables.

Every query reads the driver's tables (``conversations``, ``benchmark``,
``documents``) and returns scalar columns (arrays are reduced to sizes and
checksums), named exactly as in :mod:`dialogprep.plans.oracle`.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogprep.functions import ids as I
from dialogprep.functions import prompts as P
from dialogprep.functions.tokens import CodepointTokenizer, PieceTokenizer, byte_level_tokenizer_json
from dialogprep.operators.assemble import assemble_chunks, chunk_rows, chunk_text, examples_from_turns, pool_from_table, preferences_from_turns
from dialogprep.operators.batches import collate, pack
from dialogprep.functions.permutation import Permutation
from dialogprep.operators.epochs import epoch_order
from dialogprep.operators.examples import (
    dataset_stats,
    encode_examples,
    mark_dev_rows,
    preview,
    to_training_table,
)
from dialogprep.operators.generate import (
    decode_prediction,
    generate_column,
    generate_resumable,
    join_predictions,
    map_batches,
)
from dialogprep.operators.ordinal import file_order_index, order_rank, spread
from dialogprep.operators.preferences import (
    filter_by_length,
    preview_preferences,
    shuffle,
    split_exact,
    split_hash,
    truncate_preferences,
)
from dialogprep.operators.prompting import build_prompts, few_shot_budget, one_shot_example
from dialogprep.schema import PromptConfig
from dialogprep.session import scratch_path
from dialogprep.sources.readers import (
    read_examples,
    read_few_shot_pool,
    read_preference_rejects,
    read_preferences,
    split_corrupt,
)
from dialogprep.sources.bucketed import open_bucketed, write_bucketed
from dialogprep.sources.writers import materialize, write_document, write_predictions, write_preferences, write_submission
from dialogprep.streaming.prompts import stream_training_rows

# Query parameters (FIXTURES.md section 2).
SEED = 42
TEST_FRACTION = 0.1
FEW_SHOT_BLOCK = 4096
PREFERENCE_CUTOFF = 1024
TRUNC_MAX_LENGTH = 1024
TRUNC_MAX_PROMPT = 864
N_SHARDS = 4
PACK_GROUP_ROWS = 32
PREF_OBJECT_ROWS = 16
BATCH_SIZE = 2
EVAL_BATCH_SIZE = 4
PACK_BLOCK = 2048
BUCKETS = 8
TURN_CHUNK_BYTES = 200
EPOCHS = (0, 1)
MAP_BATCH = 1000
STEP_FILES = 64
GENERATE_BUDGET = 16384
ROW_TOKEN_LIMIT = 4096
ONE_SHOT_INDEXES = (0, 3, -1)
MAX_NEW_TOKENS = 1024

TOK = CodepointTokenizer()
CFG = PromptConfig()


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents, spread over the cores when stored in too few splits."""
    return spread(_t(spark, d, "documents").select("doc_id", "text"))


def examples(spark: SparkSession, d: str) -> DataFrame:
    return examples_from_turns(_t(spark, d, "conversations"))


def pool(spark: SparkSession, d: str) -> DataFrame:
    return pool_from_table(_t(spark, d, "benchmark"))


def _conv() -> F.Column:
    return F.col("input.conversation")


def _kw() -> F.Column:
    return F.col("input.subject_keyword")


def _cid() -> F.Column:
    return F.col("example_id").alias("conv_id")


def _big(c, name: str):
    return c.cast("bigint").alias(name)


# -- assembly and prompt text ---------------------------------------------------
def q_assemble_conversations(spark, d):
    ex = examples(spark, d)
    return ex.select(_cid(), _big(F.size(_conv()), "n_turns"),
                     F.array_join(F.transform(_conv(), lambda t: t["speaker"]), ",").alias("roles"),
                     _big(F.length("output"), "output_chars"))


def q_assemble_chunks(spark, d):
    """F1 for conversations of any length: turns in chunks of bounded bytes, and their part of the transcript and its ids."""
    c = assemble_chunks(_t(spark, d, "conversations"), max_bytes=TURN_CHUNK_BYTES)
    text = chunk_text(F.col("turns"), F.col("chunk"))
    ids = chunk_rows(c, TOK).select("conv_id", "chunk", _big(F.size("input_ids"), "n_tokens"), I.checksum(F.col("input_ids")).alias("ids_checksum"))
    return c.select("conv_id", "chunk", _big(F.size("turns"), "n_turns"), F.md5(text).alias("text_md5")).join(ids, ["conv_id", "chunk"])


def q_format_turns(spark, d):
    ex = examples(spark, d)
    return ex.select(_cid(), F.posexplode(F.transform(_conv(), lambda t: P.format_turn(t))).alias("turn", "line")
                     ).select("conv_id", _big(F.col("turn"), "turn"), "line")


def q_transcript(spark, d):
    return examples(spark, d).select(_cid(), P.transcript(_conv()).alias("transcript"))


def q_transcript_labelled(spark, d):
    return examples(spark, d).select(_cid(), P.transcript(_conv(), style="labelled").alias("transcript"))


def q_keywords_text(spark, d):
    return examples(spark, d).select(_cid(), P.keywords_text(_kw()).alias("keywords"))


def q_summary_prompt(spark, d):
    return examples(spark, d).select(_cid(), P.summary_prompt(_conv(), _kw()).alias("prompt"))


def q_topic_prompt(spark, d):
    return examples(spark, d).select(_cid(), P.topic_prompt(_conv()).alias("prompt"))


def q_domain_system_prompt(spark, d):
    return examples(spark, d).select(_cid(), P.domain_system_prompt(_kw()).alias("prompt"))


def q_instruction_prompt(spark, d):
    return examples(spark, d).select(_cid(), P.instruction_prompt(_conv(), _kw()).alias("prompt"))


def q_chat_messages(spark, d):
    ex = examples(spark, d)
    msgs = P.messages(P.system_prompt(), P.summary_prompt(_conv(), _kw()))
    return ex.select(_cid(), F.posexplode(msgs).alias("pos", "m")).select(
        "conv_id", _big(F.col("pos"), "pos"), F.col("m.role").alias("role"), F.col("m.content").alias("content"))


def q_render_chat(spark, d):
    ex = examples(spark, d)
    msgs = P.messages(P.system_prompt(), P.summary_prompt(_conv(), _kw()))
    both = ex.select(_cid(), msgs.alias("msgs"))
    return both.select(
        "conv_id",
        F.explode(F.array(
            F.struct(F.lit(1).cast("bigint").alias("g"), P.render_chat(F.col("msgs"), generation_prompt=True).alias("r")),
            F.struct(F.lit(0).cast("bigint").alias("g"), P.render_chat(F.col("msgs"), generation_prompt=False).alias("r")),
        )).alias("x"),
    ).select("conv_id", F.col("x.g").alias("with_generation_prompt"), F.col("x.r").alias("rendered"))


def _mode_configs() -> dict[str, PromptConfig]:
    return {
        "chat": PromptConfig(),
        "one_shot": PromptConfig(one_shot=True),
        "few_shot": PromptConfig(dynamic_fewshot=True, fewshot_block_size=FEW_SHOT_BLOCK),
        "tapt": PromptConfig(do_tapt=True),
        "instruction": PromptConfig(use_custom_prompt=True),
    }


def q_prompt_modes(spark, d):
    ex = materialize(examples(spark, d), "examples", spark)  # assembled once for all modes
    pl = pool(spark, d)
    out = None
    for cfg in _mode_configs().values():
        p = build_prompts(ex, cfg, pl, TOK).select(
            _cid(), "mode", F.md5("source_text").alias("prompt_md5"), _big(F.length("source_text"), "n_chars"))
        out = p if out is None else out.unionByName(p)
    return out


def q_one_shot_prompt(spark, d):
    ex = examples(spark, d)
    pl = pool(spark, d)
    out = None
    for idx in ONE_SHOT_INDEXES:
        system = P.one_shot_system(one_shot_example(pl, idx))
        p = ex.select(_cid(), F.lit(idx).cast("bigint").alias("oneshot_idx"),
                      F.md5(system).alias("system_md5"), _big(F.length(system), "n_chars"))
        out = p if out is None else out.unionByName(p)
    return out


def q_few_shot_budget(spark, d):
    b = few_shot_budget(pool(spark, d), TOK, CFG.specials_per_encode)
    return b.select(_big(F.col("pos"), "pos"), _big(F.col("n_tokens"), "n_tokens"), _big(F.col("cum_tokens"), "cum_tokens"))


def q_dynamic_few_shot(spark, d):
    cfg = _mode_configs()["few_shot"]
    p = build_prompts(examples(spark, d), cfg, pool(spark, d), TOK)
    return p.select(_cid(), _big(F.col("base_tokens"), "base_tokens"), _big(F.col("n_examples"), "n_examples"),
                    F.md5("source_text").alias("prompt_md5"), _big(F.length("source_text"), "prompt_chars"))


# -- tokens and training rows ---------------------------------------------------
def q_tokenize(spark, d):
    docs = _docs(spark, d).select("doc_id", TOK.encode(F.col("text"), add_special=True).alias("ids"))
    return docs.select("doc_id", _big(F.size("ids"), "n_tokens"), I.checksum(F.col("ids")).alias("checksum"))


def q_tokenize_pieces(spark, d):
    """The subword path: a byte-level tokenizer in an Arrow-batched iterator UDF."""
    pt = PieceTokenizer(byte_level_tokenizer_json())
    docs = _docs(spark, d).select("doc_id", "text", pt.encode(F.col("text"), add_special=True).alias("ids"))
    return docs.select("doc_id", _big(F.size("ids"), "n_tokens"), I.checksum(F.col("ids")).alias("checksum"),
                       F.md5(pt.decode(F.col("ids"))).alias("text_md5"))


def q_detokenize(spark, d):
    docs = _docs(spark, d)
    back = TOK.decode(TOK.encode(F.col("text"), add_special=True), skip_special=True)
    return docs.select("doc_id", F.md5(back).alias("text_md5"))


def _encoded(spark, d, cfg: PromptConfig = CFG) -> DataFrame:
    return encode_examples(build_prompts(examples(spark, d), cfg, pool(spark, d), TOK), TOK)


def q_sft_examples(spark, d):
    e = _encoded(spark, d)
    return e.select(
        _cid(),
        _big(F.size("source_ids"), "n_source"),
        _big(F.size("target_ids"), "n_target"),
        _big(F.size(F.filter("labels", lambda x: x == -100)), "n_masked"),
        _big(F.aggregate("attention_mask", F.lit(0), lambda z, x: z + x), "n_attended"),
        I.checksum(F.col("input_ids")).alias("ids_checksum"),
        I.checksum(F.col("labels")).alias("labels_checksum"),
    )


def q_sft_examples_pieces(spark, d):
    """The flagship through the subword path (byte-level tokenizer, Arrow-batched UDF)."""
    pt = PieceTokenizer(byte_level_tokenizer_json())
    e = encode_examples(build_prompts(examples(spark, d), CFG, None, pt), pt)
    return e.select(_cid(), _big(F.size("source_ids"), "n_source"), _big(F.size("target_ids"), "n_target"),
                    I.checksum(F.col("input_ids")).alias("ids_checksum"),
                    I.checksum(F.col("labels")).alias("labels_checksum"))


def q_tapt_examples(spark, d):
    e = _encoded(spark, d, PromptConfig(do_tapt=True))
    return e.select(_cid(), _big(F.size("input_ids"), "n_tokens"), I.checksum(F.col("labels")).alias("labels_checksum"))


def q_training_table(spark, d):
    path = scratch_path(spark, "training_table")
    to_training_table(_encoded(spark, d)).write.mode("overwrite").parquet(path)
    back = spark.read.parquet(path)
    return back.select(
        F.col("example_id").alias("conv_id"),
        _big(F.size("input_ids"), "n_tokens"),
        I.checksum(F.col("input_ids")).alias("ids_checksum"),
        I.checksum(F.col("labels")).alias("labels_checksum"),
        _big(F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda z, x: z + x), "mask_sum"),
    )


def q_preview(spark, d):
    return preview(_encoded(spark, d), TOK).select(_cid(), "input_text", "label_text")


def q_multitask_union(spark, d):
    e = _encoded(spark, d, PromptConfig(multitask=True))
    return e.select(_cid(), "task", "target_text", _big(F.size("source_ids"), "n_source")).withColumnRenamed(
        "target_text", "target")


def _train_dev(spark, d) -> DataFrame:
    e = split_hash(_encoded(spark, d), "example_id", TEST_FRACTION, SEED)
    return mark_dev_rows(e.withColumnRenamed("split", "_part"), F.col("_part") == "test")


def q_train_plus_dev(spark, d):
    return _train_dev(spark, d).select(_cid(), "split", _big(F.size("input_ids"), "n_tokens"))


def q_dataset_stats(spark, d):
    return dataset_stats(_train_dev(spark, d), ("split",), limit=ROW_TOKEN_LIMIT)


def _written(spark, d) -> DataFrame:
    """Encoded rows, written once: batching and packing are later jobs over that table."""
    e = _encoded(spark, d)
    return materialize(e.select("example_id", "source_ids", "target_ids", "input_ids", "labels"), "sft_rows", spark)


def q_collate_pad(spark, d):
    return _collated(_written(spark, d))


def _collated(e: DataFrame, length: str | None = None) -> DataFrame:
    c = collate(e, BATCH_SIZE, TOK.pad_token_id, key="example_id", n_shards=N_SHARDS, length=length)
    return c.select(
        _big(F.col("shard"), "shard"), _big(F.col("batch_id"), "batch_id"), _cid(),
        _big(F.col("pad_to"), "pad_to"), _big(F.col("pad_to") - F.size(F.col("source_ids")) - F.size(F.col("target_ids")), "n_pad"),
        _big(F.aggregate("mask", F.lit(0), lambda z, x: z + x), "n_attended"),
        I.checksum(F.col("ids")).alias("ids_checksum"), I.checksum(F.col("labels")).alias("labels_checksum"),
    )


def q_collate_eval(spark, d):
    """Evaluation loader: key order, batches of 4, mask by original length."""
    return _collate_eval(_written(spark, d))


def q_collate_eval_string_key(spark, d):
    """The same with keys of text, as records without ids have."""
    e = _written(spark, d)
    return _collate_eval(e.withColumn("example_id", F.lpad(F.col("example_id").cast("string"), 12, "0"))).withColumn(
        "conv_id", F.col("conv_id").cast("bigint"))


def _collate_eval(e: DataFrame) -> DataFrame:
    c = collate(e, EVAL_BATCH_SIZE, TOK.pad_token_id, key="example_id", order="key", mask="by_length")
    return c.select(
        _big(F.col("batch_id"), "batch_id"), _cid(), _big(F.col("pad_to"), "pad_to"),
        _big(F.aggregate("mask", F.lit(0), lambda z, x: z + x), "n_attended"),
        I.checksum(F.col("ids")).alias("ids_checksum"), I.checksum(F.col("labels")).alias("labels_checksum"),
    )


def q_tapt_multitask(spark, d):
    """Domain-adaptation rows plus topic rows (labels copied vs masked)."""
    e = _encoded(spark, d, PromptConfig(do_tapt=True, multitask=True))
    return e.select(_cid(), "task", _big(F.size("input_ids"), "n_tokens"),
                    _big(F.size(F.filter("labels", lambda x: x == -100)), "n_masked"),
                    I.checksum(F.col("labels")).alias("labels_checksum"))


def q_pack_tokens(spark, d):
    # Packing is a second job over the written training table (as a large run
    # would do): its key-order pass then reads one Parquet column.
    e = materialize(to_training_table(_encoded(spark, d)), "sft_training_rows", spark, (d, CFG, "codepoint"))
    return _packed(e)


def q_pack_string_key(spark, d):
    """Packing by keys of text, as records without ids have."""
    e = materialize(to_training_table(_encoded(spark, d)), "sft_training_rows", spark)
    return _packed(e.withColumn("example_id", F.lpad(F.col("example_id").cast("string"), 12, "0")))


def _bucketed(spark, d, *cols: str) -> DataFrame:
    """Encoded rows bucketed and sorted by key, entered in the catalog again as a later job would."""
    path = scratch_path(spark, "bucketed_rows")
    write_bucketed(_encoded(spark, d).select("example_id", *cols, F.size("input_ids").alias("n_tokens")), path, "example_id", BUCKETS)
    return open_bucketed(spark, path)


def q_collate_bucketed(spark, d):
    """The training loader over a bucketed table: token arrays stay where they are."""
    return _collated(_bucketed(spark, d, "source_ids", "target_ids", "input_ids", "labels"), length="n_tokens")


def q_pack_bucketed(spark, d):
    """Packing over a bucketed table: only the chunks' pieces move."""
    return _packed(_bucketed(spark, d, "input_ids", "labels", "attention_mask"), length="n_tokens")


def q_pack_unequal(spark, d):
    """Columns of unlike sizes: ids (the first), targets (shorter) and ids with the targets again (longer)."""
    e = _written(spark, d).select("example_id", "input_ids", "target_ids", F.concat("input_ids", "target_ids").alias("more_ids"))
    pk = pack(e, PACK_BLOCK, key="example_id", group_rows=PACK_GROUP_ROWS, cols=("input_ids", "target_ids", "more_ids"), unequal="cut")
    return pk.select(_big(F.col("group"), "group"), _big(F.col("chunk"), "chunk"), _big(F.size("input_ids"), "n_ids"), _big(F.size("target_ids"), "n_target"),
                     _big(F.size("more_ids"), "n_more"), I.checksum(F.col("target_ids")).alias("target_checksum"), I.checksum(F.col("more_ids")).alias("more_checksum"))


def _packed(e: DataFrame, length: str | None = None) -> DataFrame:
    pk = pack(e, PACK_BLOCK, key="example_id", group_rows=PACK_GROUP_ROWS, length=length)
    return pk.select(_big(F.col("group"), "group"), _big(F.col("chunk"), "chunk"),
                     _big(F.size("input_ids"), "n_tokens"),
                     I.checksum(F.col("input_ids")).alias("ids_checksum"),
                     I.checksum(F.col("labels")).alias("labels_checksum"))


# -- preferences ------------------------------------------------------------------
def _prefs(spark, d) -> DataFrame:
    return preferences_from_turns(_t(spark, d, "conversations"))


def q_preference_filter(spark, d):
    s = split_exact(_prefs(spark, d), "example_id", TEST_FRACTION, SEED)
    f = filter_by_length(s, PREFERENCE_CUTOFF)
    return f.select(_cid(), "split", _big(F.length("prompt"), "prompt_chars"),
                    _big(F.length("chosen"), "chosen_chars"), _big(F.length("rejected"), "rejected_chars"))


def q_preference_truncate(spark, d):
    t = truncate_preferences(_prefs(spark, d), TOK, TRUNC_MAX_LENGTH, TRUNC_MAX_PROMPT)
    return t.select(_cid(), _big(F.size("prompt_ids"), "n_prompt"), _big(F.size("chosen_ids"), "n_chosen"),
                    _big(F.size("rejected_ids"), "n_rejected"),
                    I.checksum(F.col("prompt_ids")).alias("prompt_checksum"),
                    I.checksum(F.col("chosen_ids")).alias("chosen_checksum"),
                    I.checksum(F.col("rejected_ids")).alias("rejected_checksum"))


def q_split_exact(spark, d):
    return split_exact(examples(spark, d), "example_id", TEST_FRACTION, SEED).select(_cid(), "split")


def q_split_hash(spark, d):
    return split_hash(examples(spark, d), "example_id", TEST_FRACTION, SEED).select(_cid(), "split")


def q_shuffle_order(spark, d):
    s = shuffle(examples(spark, d), "example_id", SEED)
    return s.select(_cid(), _big(F.col("shuffle_rank"), "rank"))


def q_shuffle_epochs(spark, d):
    """H1 as a formula: two epochs' orders over numbered rows, and the way back."""
    rows = order_rank(examples(spark, d).select("example_id"), "example_id", "pos")
    n, out = rows.count(), None
    for epoch in EPOCHS if n else ():
        r = epoch_order(rows, n, "pos", SEED, epoch, "rank")
        r = r.select(_cid(), _big(F.lit(epoch), "epoch"), "rank", _big(Permutation(n, SEED, epoch).position(F.col("rank")), "back"))
        out = r if out is None else out.unionByName(r)
    return out if n else rows.select(_cid(), _big(F.lit(0), "epoch"), _big(F.col("pos"), "rank"), _big(F.col("pos"), "back"))


# -- generation and sinks -----------------------------------------------------------
def q_continuation(spark, d):
    e = _encoded(spark, d)
    cont = I.continuation(F.col("input_ids"), F.col("source_ids"))
    return e.select(_cid(), _big(F.size(cont), "n_out"), TOK.decode(cont, skip_special=True).alias("text"))


def _inference_prompts(spark, d) -> DataFrame:
    cfg = PromptConfig(one_shot=True, oneshot_idx=0)
    p = build_prompts(examples(spark, d), cfg, None, TOK)
    return p.withColumn("source_ids", TOK.encode(F.col("source_text"), add_special=True))


def echo_line_generator(marker_ids: list[int], stop_id: int, eos_id: int,
                        max_new_tokens: int = 1024) -> Callable[[], Callable[[list], list]]:
    """A stand-in for a language model, for checks only.

    It "generates" the ids that follow the last occurrence of ``marker_ids``
    in the prompt, up to the next ``stop_id`` and at most ``max_new_tokens``,
    then EOS.  A real model is supplied by the user in the same shape.
    """
    marker = np.asarray(marker_ids, dtype=np.int64)

    def factory() -> Callable[[list], list]:
        m = len(marker)

        def gen(prompts: list) -> list:
            outs = []
            for p in prompts:
                a = np.asarray(p, dtype=np.int64)
                cont: list[int] = []
                if m and len(a) >= m:
                    win = np.lib.stride_tricks.sliding_window_view(a, m)
                    hits = np.flatnonzero((win == marker).all(axis=1))
                    if len(hits):
                        rest = a[hits[-1] + m:]
                        stops = np.flatnonzero(rest == stop_id)
                        cut = stops[0] if len(stops) else len(rest)
                        cont = rest[:min(cut, max_new_tokens)].tolist()
                outs.append(list(p) + cont + [eos_id])
            return outs

        return gen

    return factory


def _generated(spark, d) -> DataFrame:
    marker = [ord(c) + TOK.offset for c in CFG.text.conversation_header + "\n"]
    factory = echo_line_generator(marker, ord("\n") + TOK.offset, TOK.eos_token_id, MAX_NEW_TOKENS)
    g = generate_column(_inference_prompts(spark, d).select("example_id", "output", "source_ids"), factory)
    return decode_prediction(g, TOK)


def q_generate_resumable(spark, d):
    """The generator as a job with a log: steps of a few files, each prompt generated in one of them."""
    marker = [ord(c) + TOK.offset for c in CFG.text.conversation_header + "\n"]
    factory = echo_line_generator(marker, ord("\n") + TOK.offset, TOK.eos_token_id, MAX_NEW_TOKENS)
    prompts = _inference_prompts(spark, d).select("example_id", "output", "source_ids")
    g = generate_resumable(prompts, factory, scratch_path(spark, "generation"), files_per_step=STEP_FILES, token_budget=GENERATE_BUDGET)
    return decode_prediction(g, TOK).select(_cid(), "output", "predict")


def q_generate_join(spark, d):
    return _generated(spark, d).select(_cid(), "output", "predict")


def q_batched_map(spark, d):
    turns = examples(spark, d).select("example_id", F.posexplode(_conv()).alias("turn", "t")).select(
        "example_id", "turn", F.col("t.utterance").alias("utterance"))

    def per_batch(pdf):
        import pandas as pd

        rows = pdf.assign(n=pdf["utterance"].fillna("").str.len().astype("int64"))
        rows = rows[rows["n"] > 0]
        return pd.DataFrame({"conv_id": rows["example_id"].astype("int64"),
                             "turn": rows["turn"].astype("int64"), "n": rows["n"]})

    return map_batches(turns, per_batch, "conv_id bigint, turn bigint, n bigint", batch_rows=MAP_BATCH)


def q_read_examples_json(spark, d):
    path = scratch_path(spark, "examples_json")
    examples(spark, d).withColumn("source", F.lit("conversations")).write.mode("overwrite").json(path)
    back = read_examples(spark, path)
    return back.select(_cid(), _big(F.size(_conv()), "n_turns"), F.md5(P.transcript(_conv())).alias("transcript_md5"),
                       P.keywords_text(_kw()).alias("keywords"), F.md5("output").alias("output_md5"), "source")


def q_read_examples_array(spark, d):
    """A1: the records as one indented JSON array in one file, read by its splits; records are keyed by position."""
    path = scratch_path(spark, "examples_array") + ".json"
    ex = examples(spark, d).select("example_id", "input", "output", F.lit("conversations").alias("source"))
    write_document(ex.withColumnRenamed("example_id", "conv_id"), path, order_col="conv_id")
    back = read_examples(spark, path, multi_line=True)
    return back.select("conv_id", _big(F.substring_index("example_id", "-", -1), "file_pos"), _big(F.size(_conv()), "n_turns"),
                       F.md5(P.transcript(_conv())).alias("transcript_md5"), P.keywords_text(_kw()).alias("keywords"), F.md5("output").alias("output_md5"), "source")


BAD_EVERY = 7


def q_read_examples_rejects(spark, d):
    """JSON Lines in which every seventh record is cut off: the good rows and the rejects."""
    path = scratch_path(spark, "examples_broken")
    ex = examples(spark, d).select("example_id", "input", "output")
    line = F.to_json(F.struct("example_id", "input", "output"))
    cut = F.when(F.col("example_id") % BAD_EVERY == 0, F.concat(F.lit('{"example_id": '), F.col("example_id").cast("string"), F.lit(', "input": {'))).otherwise(line)
    ex.select(cut.alias("value")).write.mode("overwrite").text(path)
    schema = ex.schema
    good, bad = split_corrupt(materialize(read_examples(spark, path, schema=schema), "examples_broken_rows", spark))
    rejected = bad.select(F.regexp_extract("_corrupt_record", r"(\d+)", 1).cast("bigint").alias("conv_id"), F.lit(True).alias("rejected"))
    return good.select(_cid(), F.lit(False).alias("rejected")).unionByName(rejected)


def q_read_preferences_rejects(spark, d):
    """Preference objects of one pair, every seventh without its ``chosen``: what the reader refuses."""
    path = scratch_path(spark, "preferences_broken")
    p = _prefs(spark, d)
    arrays = [F.array(c).alias(c) for c in ("prompt", "rejected")]
    chosen = F.when(F.col("example_id") % BAD_EVERY != 0, F.array("chosen")).alias("chosen")
    # The key orders the lines over the parts, so an object's ordinal is its key's rank.
    p.orderBy("example_id").select(F.to_json(F.struct(*arrays, chosen)).alias("value")).write.mode("overwrite").text(path)
    return read_preference_rejects(spark, path, multi_line=False).select(_big(F.col("obj"), "obj"), "why")


def q_preference_preview(spark, d):
    s = filter_by_length(split_exact(_prefs(spark, d), "example_id", TEST_FRACTION, SEED), PREFERENCE_CUTOFF)
    return preview_preferences(s, "example_id", 3).select(_cid(), "prompt", "chosen", "rejected")


def q_cached_result(spark, d):
    """The second call finds the first one's folder; a changed input does not."""
    path = scratch_path(spark, "cache_input")
    ex = examples(spark, d).select("example_id", "output")
    ex.filter("example_id % 2 = 0").write.parquet(path)
    first = materialize(spark.read.parquet(path), "outputs", spark, config="v1", reuse=True)
    again = materialize(spark.read.parquet(path), "outputs", spark, config="v1", reuse=True)
    ex.filter("example_id % 2 = 1").write.mode("append").parquet(path)
    changed = materialize(spark.read.parquet(path), "outputs", spark, config="v1", reuse=True)
    same = {f.rsplit("/", 1)[0] for f in first.inputFiles()} == {f.rsplit("/", 1)[0] for f in again.inputFiles()}
    return changed.select(_cid(), F.md5("output").alias("output_md5"), F.lit(same).alias("reused"))


def q_cached_computations(spark, d):
    """One name, file and config, but two filters: each result is its own, and each is found again."""
    path = scratch_path(spark, "cache_source")
    examples(spark, d).select("example_id", "output").write.parquet(path)
    table = spark.read.parquet(path)
    out = None
    for part, cond in (("even", "example_id % 2 = 0"), ("third", "example_id % 3 = 0")):
        first = materialize(table.filter(cond), "filtered", spark, config="v1", reuse=True)
        again = materialize(spark.read.parquet(path).filter(cond), "filtered", spark, config="v1", reuse=True)
        rows = again.select(F.lit(part).alias("part"), _cid(), F.md5("output").alias("output_md5"), F.lit(first.inputFiles() == again.inputFiles()).alias("reused"))
        out = rows if out is None else out.unionByName(rows)
    return out


def q_read_few_shot_csv(spark, d):
    path = scratch_path(spark, "pool_csv")
    pool(spark, d).orderBy("pos").select("text").write.mode("overwrite").option("header", True) \
        .option("escape", '"').option("quoteAll", True).csv(path)
    back = read_few_shot_pool(spark, path)
    return back.select(_big(F.col("pos"), "pos"), F.md5("text").alias("text_md5"))


def q_read_preferences_json(spark, d):
    path = scratch_path(spark, "preferences_json")
    write_preferences(_prefs(spark, d), path, rows_per_object=PREF_OBJECT_ROWS)
    back = read_preferences(spark, path, multi_line=False)
    return back.select(F.md5("prompt").alias("prompt_md5"), F.md5("chosen").alias("chosen_md5"),
                       F.md5("rejected").alias("rejected_md5"))


def q_predictions_jsonl(spark, d):
    path = scratch_path(spark, "predictions_jsonl")
    preds = _generated(spark, d).select("example_id", "predict")
    write_predictions(preds, path)
    back = spark.read.schema("example_id bigint, predict string").json(path)
    joined = join_predictions(examples(spark, d), back, "example_id")
    return joined.select(_cid(), F.md5("output").alias("output_md5"), "predict")


def q_submission_records(spark, d):
    path = scratch_path(spark, "submission")
    sub = _generated(spark, d).select(F.col("example_id").alias("pos"), "example_id", F.col("predict").alias("output"))
    write_submission(sub, path, order_col="pos", as_json_array=True)
    # Read the array back line by line: drop the brackets, strip separators.
    lines = spark.read.text(path)
    lines = file_order_index(lines, rank_col="line_rank").filter(~F.trim("value").isin("[", "]"))
    body = F.regexp_replace(F.trim("value"), r",$", "")
    rec = lines.select("line_rank", F.from_json(body, "pos bigint, example_id bigint, output string").alias("r"))
    ranked = order_rank(rec.select("line_rank", "r.*"), "line_rank", "file_rank")
    return ranked.select(_cid(), _big(F.col("file_rank"), "file_rank"), F.md5("output").alias("output_md5"))


def q_submission_document(spark, d):
    """The submission as one indented file, read back by position."""
    path = scratch_path(spark, "submission_document") + ".json"
    sub = _generated(spark, d).select("example_id", F.col("predict").alias("output"))
    write_document(sub, path, order_col="example_id")
    back = read_examples(spark, path, multi_line=True, id_col="place")
    return back.select(_cid(), _big(F.substring_index("place", "-", -1), "file_rank"), F.md5("output").alias("output_md5"))


def q_stream_prompts(spark, d):
    src = scratch_path(spark, "stream_src")
    examples(spark, d).write.mode("overwrite").parquet(src)
    out = stream_training_rows(spark, src, scratch_path(spark, "stream_out"), CFG, TOK,
                               scratch_path(spark, "stream_ckpt"))
    return out.select(_cid(), _big(F.size("source_ids"), "n_source"),
                      I.checksum(F.col("input_ids")).alias("ids_checksum"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "assemble_conversations": q_assemble_conversations,
    "format_turns": q_format_turns,
    "transcript": q_transcript,
    "transcript_labelled": q_transcript_labelled,
    "keywords_text": q_keywords_text,
    "summary_prompt": q_summary_prompt,
    "topic_prompt": q_topic_prompt,
    "domain_system_prompt": q_domain_system_prompt,
    "instruction_prompt": q_instruction_prompt,
    "chat_messages": q_chat_messages,
    "render_chat": q_render_chat,
    "prompt_modes": q_prompt_modes,
    "one_shot_prompt": q_one_shot_prompt,
    "few_shot_budget": q_few_shot_budget,
    "dynamic_few_shot": q_dynamic_few_shot,
    "tokenize": q_tokenize,
    "detokenize": q_detokenize,
    "tokenize_pieces": q_tokenize_pieces,
    "sft_examples": q_sft_examples,
    "sft_examples_pieces": q_sft_examples_pieces,
    "tapt_examples": q_tapt_examples,
    "training_table": q_training_table,
    "preview": q_preview,
    "multitask_union": q_multitask_union,
    "train_plus_dev": q_train_plus_dev,
    "dataset_stats": q_dataset_stats,
    "collate_pad": q_collate_pad,
    "pack_tokens": q_pack_tokens,
    "collate_eval": q_collate_eval,
    "collate_eval_string_key": q_collate_eval_string_key,
    "pack_string_key": q_pack_string_key,
    "read_examples_rejects": q_read_examples_rejects,
    "read_preferences_rejects": q_read_preferences_rejects,
    "preference_preview": q_preference_preview,
    "cached_result": q_cached_result,
    "tapt_multitask": q_tapt_multitask,
    "preference_filter": q_preference_filter,
    "preference_truncate": q_preference_truncate,
    "split_exact": q_split_exact,
    "split_hash": q_split_hash,
    "shuffle_order": q_shuffle_order,
    "continuation": q_continuation,
    "generate_join": q_generate_join,
    "batched_map": q_batched_map,
    "read_examples_json": q_read_examples_json,
    "read_few_shot_csv": q_read_few_shot_csv,
    "read_preferences_json": q_read_preferences_json,
    "predictions_jsonl": q_predictions_jsonl,
    "submission_records": q_submission_records,
    "stream_prompts": q_stream_prompts,
    "collate_bucketed": q_collate_bucketed,
    "pack_bucketed": q_pack_bucketed,
    "pack_unequal": q_pack_unequal,
    "shuffle_epochs": q_shuffle_epochs,
    "generate_resumable": q_generate_resumable,
    "assemble_chunks": q_assemble_chunks,
    "read_examples_array": q_read_examples_array,
    "cached_computations": q_cached_computations,
    "submission_document": q_submission_document,
}
