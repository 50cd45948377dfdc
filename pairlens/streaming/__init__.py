"""Incremental ingest and progress over a growing result log (Structured Streaming)."""
