"""Structured Streaming forms of the core aggregations."""
