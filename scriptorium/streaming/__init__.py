"""Incremental ingestion with Structured Streaming (AvailableNow + foreachBatch)."""
