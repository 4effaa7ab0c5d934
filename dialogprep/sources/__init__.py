"""Readers and writers."""

from dialogprep.sources.bucketed import open_bucketed, write_bucketed  # noqa: F401
from dialogprep.sources.json_array import read_json_array  # noqa: F401
from dialogprep.sources.readers import (  # noqa: F401
    load_examples,
    read_examples,
    read_few_shot_pool,
    read_preference_rejects,
    read_preferences,
    split_corrupt,
)
from dialogprep.sources.writers import (  # noqa: F401
    materialize,
    record_json,
    write_document,
    write_predictions,
    write_preferences,
    write_submission,
)
