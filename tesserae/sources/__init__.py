"""Keeping a catalog up to date, and finding objects in a source."""
