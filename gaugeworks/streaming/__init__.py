"""Structured Streaming forms of the alarm operators."""
