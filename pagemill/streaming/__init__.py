"""Structured Streaming twins of the time-driven state jobs."""
