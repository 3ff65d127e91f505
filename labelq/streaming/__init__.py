"""Structured Streaming forms of the accumulating operators."""
