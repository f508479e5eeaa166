"""Finding objects by their properties, and applying something to them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def find(
    objects: DataFrame, ids: Iterable[str] | None = None, types: Iterable[str] | None = None, term: str | None = None,
    expr: str | None = None, modified: dt.datetime | None = None, modified_is: str = "more", permission: str | None = None,
    roles: Iterable[str] = (), prefix: str | None = None, id_col: str = "id", type_col: str = "meta_type", text_col: str = "text",
    mtime_col: str = "mtime", path_col: str = "path", permissions_col: str = "permissions",
) -> DataFrame:
    """The objects that satisfy every condition given.

    ``term`` is a substring of the text, ``expr`` a boolean SQL expression (an error in
    it is an error of the query), ``modified`` the earliest modification time, or the latest
    with ``modified_is="less"``; ``permission`` with ``roles`` asks the column
    ``permissions_col`` (a map from permission to roles); ``prefix`` restricts to a subtree.
    """
    conditions: list[Column] = []
    if ids:
        conditions.append(F.col(id_col).isin(*ids))
    if types:
        conditions.append(F.col(type_col).isin(*types))
    if term:
        conditions.append(F.contains(F.col(text_col), F.lit(term)))
    if expr:
        conditions.append(F.coalesce(F.expr(expr).cast("boolean"), F.lit(False)))
    if modified is not None:
        conditions.append(F.col(mtime_col) <= F.lit(modified) if modified_is == "less" else F.col(mtime_col) >= F.lit(modified))
    if permission:
        conditions.append(F.arrays_overlap(F.col(permissions_col)[permission], F.array(*[F.lit(r) for r in roles])))
    if prefix:
        conditions.append((F.col(path_col) == prefix) | F.startswith(F.col(path_col), F.lit(prefix.rstrip("/") + "/")))
    return objects.where(reduce(lambda a, b: a & b, conditions)) if conditions else objects


def find_and_apply(objects: DataFrame, apply: Callable[[Iterable], None], **conditions) -> None:
    """Call ``apply`` with the found rows of each partition, on the executors."""
    find(objects, **conditions).foreachPartition(apply)
