"""Index kinds, text search, sorting, facets and merging."""
