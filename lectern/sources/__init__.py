"""Sources of the lectern package."""
