"""Incremental (Structured Streaming) form of the per-file analysis."""

from .incremental import stream_file_facts  # noqa: F401
