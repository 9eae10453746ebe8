"""Structured Streaming variants of the state operators."""
