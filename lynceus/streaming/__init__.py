"""Structured Streaming forms of the session log."""
