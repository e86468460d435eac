"""Structured Streaming variants of the change capture and of the counts."""
