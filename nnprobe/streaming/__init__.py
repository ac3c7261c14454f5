"""Structured Streaming views over measurement rows."""
