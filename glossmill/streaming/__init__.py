"""Streaming forms of the log of lookups."""
