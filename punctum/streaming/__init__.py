"""Structured Streaming forms of operators that need only static side tables."""
