"""Structured Streaming around the incremental load."""
