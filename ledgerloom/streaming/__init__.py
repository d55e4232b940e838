"""Structured Streaming sources, sinks and products."""
