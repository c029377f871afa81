"""Structured Streaming: continuous ingest and request monitoring."""
