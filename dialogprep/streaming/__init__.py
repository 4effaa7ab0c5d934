"""Streaming entry points (row-wise operators on file streams)."""

from dialogprep.streaming.prompts import prepare_stream, stream_training_rows  # noqa: F401
