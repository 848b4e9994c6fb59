"""Structured Streaming ingest and incremental KPIs."""
