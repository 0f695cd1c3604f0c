"""Structured Streaming variant of the landing ingest."""
