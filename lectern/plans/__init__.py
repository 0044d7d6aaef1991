"""Plans of the lectern package."""
