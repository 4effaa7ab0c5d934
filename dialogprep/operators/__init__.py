"""DataFrame -> DataFrame operators (usable with ``df.transform``)."""

from dialogprep.operators.assemble import (  # noqa: F401
    assemble_chunks,
    assemble_conversations,
    chunk_rows,
    chunk_text,
    examples_from_turns,
    pool_from_table,
    preferences_from_turns,
    top_keywords,
)
from dialogprep.operators.batches import collate, pack, shard_of  # noqa: F401
from dialogprep.operators.epochs import epoch_order, epoch_rows  # noqa: F401
from dialogprep.operators.examples import (  # noqa: F401
    concat_splits,
    dataset_stats,
    encode_examples,
    mark_dev_rows,
    preview,
    to_training_table,
)
from dialogprep.operators.generate import (  # noqa: F401
    decode_prediction,
    generate_column,
    generate_resumable,
    join_predictions,
    map_batches,
    with_prediction,
)
from dialogprep.operators.ordinal import (  # noqa: F401
    order_rank,
    spread,
    file_order_index,
    hash_prefix_bucket,
    ordered_index,
    by_range,
    add_position,
    position_columns,
)
from dialogprep.operators.preferences import (  # noqa: F401
    filter_by_length,
    preview_preferences,
    shuffle,
    split_exact,
    split_hash,
    truncate_preferences,
)
from dialogprep.operators.prompting import (  # noqa: F401
    build_prompts,
    dynamic_few_shot,
    few_shot_budget,
    few_shot_prefix,
    one_shot_example,
)
