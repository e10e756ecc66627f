"""Incremental forms of the ingest operators on Structured Streaming."""
