"""Readers with guards, and sinks."""
