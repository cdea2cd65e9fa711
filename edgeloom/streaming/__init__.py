"""Structured Streaming additions: the batch operators on edges that keep arriving."""
