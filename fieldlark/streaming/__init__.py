"""Structured Streaming counterparts of the ingest stages."""
