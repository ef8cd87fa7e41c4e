"""Structured Streaming versions of ingest, de-duplication, upsert,
daily metrics and index maintenance (K1-K5)."""
