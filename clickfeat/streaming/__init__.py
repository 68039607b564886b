"""Structured Streaming: incremental log statistics."""
