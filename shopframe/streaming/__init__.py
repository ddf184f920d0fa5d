"""Structured Streaming versions of the change operators."""
