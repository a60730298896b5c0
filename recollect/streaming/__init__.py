"""Structured Streaming readers and metrics."""
