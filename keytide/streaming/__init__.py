"""Structured Streaming: ingest and the live view."""
