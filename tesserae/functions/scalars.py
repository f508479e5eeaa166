"""Paths, truth and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def components(path: Column) -> Column:
    """The non-empty components of a path."""
    return F.filter(F.split(path, "/"), lambda x: x != "")


def path_components(path: str) -> list[str]:
    return [x for x in path.split("/") if x]


def truth(value: Column, kind: str) -> Column:
    """Whether a value counts as true: not zero, not empty. Null stays null."""
    if kind == "boolean":
        return value
    if kind == "string" or kind == "binary":
        return F.length(value) > 0
    if kind.startswith(("array", "map")):
        return F.size(value) > 0
    if kind.startswith(("date", "timestamp", "struct")):
        return value.isNotNull()
    return value != 0


def normalized_path(path: Column) -> Column:
    """One slash before each component."""
    return F.concat(F.lit("/"), F.array_join(components(path), "/"))


def url(path: Column, base: str) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), F.ltrim(path, F.lit("/")))
