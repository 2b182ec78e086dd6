"""Structured Streaming: incremental first-wins deduplication."""
