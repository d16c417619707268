"""Structured Streaming versions of the monitoring operators."""
