"""Structured Streaming: the same normalization as in batch, fanned out to tables."""
