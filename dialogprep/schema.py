"""Types and configuration objects.

Everything here is plain, immutable configuration: the struct types of the
nested dialogue record, the wording of the prompt sections, the chat template
and the switches that choose a prompt mode.  Data never lives in these
objects; operators read them at plan time and fold them into literals.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# The label value that tells the loss to ignore a position.
IGNORE_INDEX = -100

TURN_TYPE = T.StructType(
    [
        T.StructField("speaker", T.StringType()),
        T.StructField("utterance", T.StringType()),
    ]
)

INPUT_TYPE = T.StructType(
    [
        T.StructField("conversation", T.ArrayType(TURN_TYPE)),
        T.StructField("subject_keyword", T.ArrayType(T.StringType())),
    ]
)

# One dialogue example.  Unknown extra fields are carried as further columns.
EXAMPLE_SCHEMA = T.StructType(
    [
        T.StructField("example_id", T.LongType()),
        T.StructField("input", INPUT_TYPE),
        T.StructField("output", T.StringType()),
    ]
)

MESSAGE_TYPE = T.StructType(
    [
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
    ]
)


# The section layout of the prompts.  The headers, separators and
# slot positions follow the reference's prompt structure; the sentences are our
# own default wording and every field can be replaced by the caller.
DEFAULT_SYSTEM = (
    "Your task is to work with a recorded dialogue.\n"
    "Base every answer on what its speakers say."
)
DEFAULT_ONE_SHOT = (
    "[Example 1]\n"
    + DEFAULT_SYSTEM
    + "\n\n[Conversation]\n"
    "A: My bicycle chain came off twice on the way here.\n"
    "B: Is the rear wheel straight? Mine did that after a fall.\n"
    "A: It leans a little to the left, now that you mention it.\n"
    "\n[Question]\nGive the gist of this dialogue (bicycle, repair).\n"
    "\n[Answer]\n"
    "A's bicycle chain keeps coming off. B suspects the rear wheel, and A "
    "notices that it is not straight."
)


@dataclass(frozen=True)
class PromptText:
    """Wording of every prompt section.  ``{keywords}`` marks the keyword slot."""

    system: str = DEFAULT_SYSTEM
    domain_system: str = (
        "Your task is to work with a recorded dialogue.\n"
        "Its subject: {keywords}."
    )
    conversation_header: str = "[Conversation]"
    question_header: str = "[Question]"
    summary_question: str = "Give the gist of this dialogue ({keywords})."
    topic_question: str = "Which subjects come up in this dialogue?"
    turn_separator: str = ": "
    speaker_label: str = "Speaker "
    instruction: str = (
        "A dialogue follows, then a request about it.\n"
        "Reply with one short paragraph in plain words."
    )
    instruction_user: str = "Put this dialogue in a few sentences; subject: {keywords}."
    instruction_headers: tuple[str, str, str, str] = (
        "### Instruction",
        "### Conversation",
        "### User",
        "### Assistant",
    )
    keyword_separator: str = ", "
    example_header: str = "[Example {i}]\n"
    example_separator: str = "\n\n---\n\n"
    one_shot_example: str = DEFAULT_ONE_SHOT


@dataclass(frozen=True)
class ChatTemplate:
    """A chat template reduced to the parts that shape the rendered text.

    Each message renders as ``turn_start.format(role=...) + content + turn_end``;
    ``generation_prompt`` is appended when asked for.  ``system_policy`` is
    ``"native"`` (system is a turn of its own) or ``"merge"`` (the system text is
    put in front of the first user message, separated by ``merge_separator``).
    Special tokens are not part of the text: the tokenizer adds their ids.
    """

    turn_start: str = "<|{role}|>\n"
    turn_end: str = "<|end|>\n"
    generation_prompt: str = "<|assistant|>\n"
    system_policy: str = "native"
    merge_separator: str = "\n\n"
    role_names: tuple[tuple[str, str], ...] = field(default_factory=tuple)


@dataclass(frozen=True)
class PromptConfig:
    """The data switches of the training job, resolved at plan time.

    Precedence follows the reference: ``do_tapt`` wins over
    ``use_custom_prompt``, which wins over chat; inside chat ``one_shot`` wins
    over ``dynamic_fewshot``.
    """

    do_tapt: bool = False
    use_custom_prompt: bool = False
    one_shot: bool = False
    oneshot_idx: int = 0
    dynamic_fewshot: bool = False
    fewshot_block_size: int = 8192
    multitask: bool = False
    specials_per_encode: int = 1
    text: PromptText = field(default_factory=PromptText)
    template: ChatTemplate = field(default_factory=ChatTemplate)

    @property
    def mode(self) -> str:
        if self.do_tapt:
            return "tapt"
        if self.use_custom_prompt:
            return "instruction"
        if self.one_shot:
            return "one_shot"
        if self.dynamic_fewshot:
            return "few_shot"
        return "chat"
