"""Structured Streaming forms of the count aggregations."""
