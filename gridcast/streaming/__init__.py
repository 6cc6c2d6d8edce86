"""Bounded-latency ingestion on Structured Streaming."""
