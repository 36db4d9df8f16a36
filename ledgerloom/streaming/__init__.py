"""Structured Streaming operators of the publication stream."""
