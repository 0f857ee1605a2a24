"""Structured Streaming re-aims of the reference's event-like parts (STR1-STR4)."""
