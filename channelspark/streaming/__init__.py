"""Structured Streaming versions of the log summaries."""
