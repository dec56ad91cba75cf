"""Structured Streaming versions of the ingest and progress operators."""
