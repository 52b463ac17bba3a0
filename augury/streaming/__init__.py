"""Streaming forms of the batch operators; with ``availableNow`` they give the batch result."""
