from pyspark.sql import functions as F

from dialogprep.functions import prompts as P
from dialogprep.schema import ChatTemplate, PromptText
from tests.conftest import make_examples

TX = PromptText()


def _one(df, col):
    return df.select(col.alias("x")).collect()[0]["x"]


def test_transcript_plain_and_edge_text(spark):
    df = make_examples(spark, [(1, [("A", "hi\nthere"), ("B", 'say "x" 😀 한국어')], ["k"], "o")])
    conv = F.col("input.conversation")
    assert _one(df, P.transcript(conv)) == '[Conversation]\nA: hi\nthere\nB: say "x" 😀 한국어'
    assert _one(df, P.transcript(conv, style="labelled")) == 'Speaker A: hi\nthere\nSpeaker B: say "x" 😀 한국어\n'


def test_empty_conversation_and_keywords(spark):
    df = make_examples(spark, [(1, [], [], "")])
    conv, kw = F.col("input.conversation"), F.col("input.subject_keyword")
    assert _one(df, P.transcript(conv)) == "[Conversation]"
    assert _one(df, P.transcript(conv, style="labelled")) == ""
    assert _one(df, P.keywords_text(kw)) == ""
    q = TX.summary_question.replace("{keywords}", "")
    assert _one(df, P.summary_prompt(conv, kw)) == "[Conversation]\n\n[Question]\n" + q


def test_null_speaker_or_utterance_render_empty(spark):
    df = make_examples(spark, [(1, [(None, "x"), ("B", None)], ["a"], "o")])
    assert _one(df, P.transcript(F.col("input.conversation"))) == "[Conversation]\n: x\nB: "


def test_keyword_slot_one_and_three(spark):
    df = make_examples(spark, [(1, [], ["a"], ""), (2, [], ["a", "b", "c"], "")]).orderBy("example_id")
    got = [r["x"] for r in df.select(P.domain_system_prompt(F.col("input.subject_keyword")).alias("x")).collect()]
    assert got == [TX.domain_system.replace("{keywords}", "a"), TX.domain_system.replace("{keywords}", "a, b, c")]


def test_instruction_prompt_layout(spark):
    df = make_examples(spark, [(1, [("A", "u")], ["k"], "o")])
    got = _one(df, P.instruction_prompt(F.col("input.conversation"), F.col("input.subject_keyword")))
    h1, h2, h3, h4 = TX.instruction_headers
    want = (f"{h1}\n{TX.instruction}\n\n{h2}\nSpeaker A: u\n\n\n{h3}\n"
            + TX.instruction_user.replace("{keywords}", "k") + f"\n\n{h4}\n")
    assert got == want


def test_render_chat_native_and_merge(spark):
    df = spark.range(1)
    msgs = P.messages(F.lit("S"), F.lit("U"))
    native = _one(df, P.render_chat(msgs, ChatTemplate(), True))
    assert native == "<|system|>\nS<|end|>\n<|user|>\nU<|end|>\n<|assistant|>\n"
    merged = _one(df, P.render_chat(msgs, ChatTemplate(system_policy="merge",
                                                       role_names=(("user", "human"),)), False))
    assert merged == "<|human|>\nS\n\nU<|end|>\n"


def test_one_shot_system_separator(spark):
    got = _one(spark.range(1), P.one_shot_system(F.lit("EX")))
    assert got == "EX\n\n---\n\n" + TX.system
