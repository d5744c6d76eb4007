"""Incremental loads as Structured Streaming jobs that stop when the landing folder is drained."""
