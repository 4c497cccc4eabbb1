"""Structured Streaming: ingest fan-out, windows and stateful suppression."""
