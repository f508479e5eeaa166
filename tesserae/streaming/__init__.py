"""Incremental maintenance of a catalog's table from streams."""
