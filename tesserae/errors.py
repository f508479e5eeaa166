"""Errors that callers may want to tell apart."""


class CatalogError(Exception):
    """A request that the catalog's declaration can't serve."""


class QueryError(Exception):
    """A text query that can't be run, such as a pattern that starts with a wildcard."""


class ParseError(Exception):
    """A text query that doesn't follow the grammar."""
