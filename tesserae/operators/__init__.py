"""Linking, document building, indexing and ranked retrieval."""
