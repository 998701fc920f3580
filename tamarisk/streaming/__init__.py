"""Structured Streaming forms of the same transforms."""
