"""Structured Streaming: change feeds, idempotent ingest, windows, sessions, workers."""
