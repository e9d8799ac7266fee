"""Streaming ingest and usage limits."""
