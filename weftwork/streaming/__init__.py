"""Structured Streaming forms of the operators that keep state or write as records arrive."""
