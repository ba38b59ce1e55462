"""Streaming forms of the plans."""
