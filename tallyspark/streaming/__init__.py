"""Structured Streaming forms of the batch operators; extensions of what is replayed in batch."""
