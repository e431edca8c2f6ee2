"""Structured Streaming forms of hours and blocks."""
