"""dialogprep - dialogue data preparation for language-model training on Spark."""

from dialogprep.schema import (  # noqa: F401
    EXAMPLE_SCHEMA,
    IGNORE_INDEX,
    ChatTemplate,
    PromptConfig,
    PromptText,
)
from dialogprep.session import get_spark, scratch_path  # noqa: F401

__version__ = "0.1.0"
