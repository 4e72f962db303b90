"""Structured Streaming forms, additions to the batch operators."""
