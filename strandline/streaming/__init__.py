"""Structured Streaming forms of the online operators."""
