"""Prompt construction as Column -> Column functions.

All helpers are built from native expressions (``concat``, ``array_join``,
``transform``), so they run inside whole-stage code generation and apply to
batch and streaming DataFrames alike.  Wording comes from
:class:`~dialogprep.schema.PromptText` and is folded into literals at plan time.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dialogprep.schema import MESSAGE_TYPE, ChatTemplate, PromptText

_TEXT = PromptText()


def _s(x: Column) -> Column:
    """Null-safe string: a null speaker or utterance renders as ''."""
    return F.coalesce(x, F.lit(""))


def format_turn(turn: Column, text: PromptText = _TEXT) -> Column:
    """B1: ``"{speaker}: {utterance}"`` for one turn struct."""
    return F.concat(_s(turn["speaker"]), F.lit(text.turn_separator), _s(turn["utterance"]))


def transcript(conv: Column, text: PromptText = _TEXT, style: str = "plain") -> Column:
    """The conversation block.

    ``plain``: header line, then one line per turn, joined by newlines.
    ``labelled``: every turn as ``label + speaker: utterance`` followed by a
    newline (trailing newline kept, no header).
    """
    conv = F.coalesce(conv, F.array())
    if style == "plain":
        lines = F.transform(conv, lambda t: format_turn(t, text))
        return F.array_join(F.concat(F.array(F.lit(text.conversation_header)), lines), "\n")
    if style == "labelled":
        return F.array_join(
            F.transform(
                conv,
                lambda t: F.concat(F.lit(text.speaker_label), format_turn(t, text), F.lit("\n")),
            ),
            "",
        )
    raise ValueError(f"unknown transcript style {style!r}")


def keywords_text(kw: Column, text: PromptText = _TEXT) -> Column:
    """Keyword list joined with ``", "`` ('' for an empty list)."""
    return F.array_join(F.coalesce(kw, F.array()), text.keyword_separator)


def fill_keywords(template: str, kw: Column, text: PromptText = _TEXT) -> Column:
    """Put the joined keywords into every ``{keywords}`` slot of ``template``."""
    pieces = template.split("{keywords}")
    parts: list[Column] = [F.lit(pieces[0])]
    for piece in pieces[1:]:
        parts += [keywords_text(kw, text), F.lit(piece)]
    return F.concat(*parts)


def _with_question(body: Column, question: Column, text: PromptText) -> Column:
    return F.concat(body, F.lit("\n\n" + text.question_header + "\n"), question)


def summary_prompt(conv: Column, kw: Column, text: PromptText = _TEXT) -> Column:
    """Transcript, blank line, question block with the keyword slot."""
    return _with_question(transcript(conv, text), fill_keywords(text.summary_question, kw, text), text)


def topic_prompt(conv: Column, text: PromptText = _TEXT) -> Column:
    """Transcript, blank line, topic-extraction question (no slot)."""
    return _with_question(transcript(conv, text), F.lit(text.topic_question), text)


def system_prompt(text: PromptText = _TEXT) -> Column:
    """The constant system prompt."""
    return F.lit(text.system)


def domain_system_prompt(kw: Column, text: PromptText = _TEXT) -> Column:
    """The domain-adaptation system prompt with the keyword slot."""
    return fill_keywords(text.domain_system, kw, text)


def messages(system: Column | None, user: Column) -> Column:
    """``[{role: system, content}, {role: user, content}]``."""
    items = []
    if system is not None:
        items.append(F.struct(F.lit("system").alias("role"), system.alias("content")))
    items.append(F.struct(F.lit("user").alias("role"), user.alias("content")))
    return F.array(*items).cast("array<struct<role:string,content:string>>")


def one_shot_system(example: Column, text: PromptText = _TEXT) -> Column:
    """Worked example, separator, then the system prompt."""
    return F.concat(example, F.lit(text.example_separator + text.system))


def instruction_prompt(conv: Column, kw: Column, text: PromptText = _TEXT) -> Column:
    """Four headed sections in one string; bypasses the chat template."""
    h_ins, h_conv, h_user, h_asst = text.instruction_headers
    return F.concat(
        F.lit(f"{h_ins}\n{text.instruction}\n\n{h_conv}\n"),
        transcript(conv, text, style="labelled"),
        F.lit(f"\n\n{h_user}\n"),
        fill_keywords(text.instruction_user, kw, text),
        F.lit(f"\n\n{h_asst}\n"),
    )


def render_chat(msgs: Column, template: ChatTemplate = ChatTemplate(),
                generation_prompt: bool = True) -> Column:
    """Apply a chat template to a message array and return the text."""
    msgs = F.coalesce(msgs, F.array().cast(f"array<{MESSAGE_TYPE.simpleString()}>"))
    if template.system_policy == "merge":
        sys_text = F.array_join(
            F.transform(F.filter(msgs, lambda m: m["role"] == "system"), lambda m: _s(m["content"])),
            template.merge_separator,
        )
        has_sys = F.exists(msgs, lambda m: m["role"] == "system")
        rest = F.filter(msgs, lambda m: m["role"] != "system")
        msgs = F.transform(
            rest,
            lambda m, i: F.struct(
                m["role"].alias("role"),
                F.when((i == 0) & has_sys,
                       F.concat(sys_text, F.lit(template.merge_separator), _s(m["content"])))
                .otherwise(_s(m["content"])).alias("content"),
            ),
        )
    elif template.system_policy != "native":
        raise ValueError(f"unknown system policy {template.system_policy!r}")

    start_pre, _, start_post = template.turn_start.partition("{role}")
    names = dict(template.role_names)

    def role_of(m: Column) -> Column:
        r = m["role"]
        for src, dst in names.items():
            r = F.when(m["role"] == src, F.lit(dst)).otherwise(r)
        return _s(r)

    body = F.array_join(
        F.transform(
            msgs,
            lambda m: F.concat(F.lit(start_pre), role_of(m), F.lit(start_post),
                               _s(m["content"]), F.lit(template.turn_end)),
        ),
        "",
    )
    if generation_prompt:
        body = F.concat(body, F.lit(template.generation_prompt))
    return body
