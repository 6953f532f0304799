"""Structured Streaming variants of the operators that allow it."""
