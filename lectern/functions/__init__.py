"""Functions of the lectern package."""
