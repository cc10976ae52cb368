"""Structured Streaming forms of the journal operators."""
