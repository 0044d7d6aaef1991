"""Operators of the lectern package."""
