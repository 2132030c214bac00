"""Structured Streaming: ordered ingest of session lines."""
