"""Structured Streaming: incremental ingest of landed payroll files."""
