"""Structured Streaming: replay a saved recipe on files as they arrive."""
