"""Structured Streaming forms of the change queue."""
