"""Structured Streaming forms of ingest, dedup, metrics, detection and resolution."""
