"""Structured Streaming form of the landing job (the only incremental process of the reference)."""
