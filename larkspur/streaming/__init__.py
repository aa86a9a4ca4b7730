"""Structured Streaming forms of operators that need only a bounded past."""
