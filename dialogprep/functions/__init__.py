"""Column -> Column building blocks: prompts, tokenizers, id arrays."""

from dialogprep.functions.ids import (  # noqa: F401
    as_long,
    checksum,
    concat_ids,
    continuation,
    full_labels,
    masked_labels,
    ones_mask,
    target_ids,
    unmask_labels,
)
from dialogprep.functions.prompts import (  # noqa: F401
    domain_system_prompt,
    fill_keywords,
    format_turn,
    instruction_prompt,
    keywords_text,
    messages,
    one_shot_system,
    render_chat,
    summary_prompt,
    system_prompt,
    topic_prompt,
    transcript,
)
from dialogprep.functions.tokens import IDS_TYPE, CodepointTokenizer, PieceTokenizer  # noqa: F401
