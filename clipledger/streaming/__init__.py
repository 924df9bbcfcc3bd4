"""Structured Streaming versions of the ordered operators and rollups."""
