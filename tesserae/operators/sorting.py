"""Sorting, limits and batches (O)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.kinds import Kind
from tesserae.plans.query import Window


def sort_columns(kinds: list[Kind], descending: tuple[bool, ...]) -> tuple[list[Column], list[Column]]:
    """(order, present): the sort keys with their directions, and the conditions that they exist.

    Ties go by record id, in the direction of the last key.
    """
    order, present = [], []
    for kind, down in zip(kinds, descending, strict=True):
        for key in kind.sort_keys():
            order.append(key.desc() if down else key.asc())
            present.append(key.isNotNull())
    order.append(F.col("rid").desc() if descending[-1] else F.col("rid").asc())
    return order, present


def windowed(df: DataFrame, window: Window) -> DataFrame:
    """The rows of ``window``; with an order above it Spark keeps only the best in each task."""
    if window.stop is not None:
        if window.start:
            return df.offset(window.start).limit(max(0, window.stop - window.start))
        return df.limit(window.stop)
    return df.offset(window.start) if window.start else df
