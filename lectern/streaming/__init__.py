"""Streaming of the lectern package."""
