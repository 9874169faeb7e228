"""Stateful operators, in batch and as Structured Streaming."""
