"""Incremental ingestion of streams."""
