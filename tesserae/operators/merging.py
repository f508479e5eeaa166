"""Results of several catalogs as one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.errors import CatalogError


def concatenated(results: list[DataFrame]) -> DataFrame:
    """All rows of all results, repeated ones included."""
    if not results:
        raise ValueError("there are no results to merge")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), results)


def merged(results: list, has_sort_keys: bool, reverse: bool = False) -> DataFrame:
    """Merge raw results (``Catalog.search(..., merge=False)``): sorted by key, or else concatenated.

    Scored results without a sort order are ordered by ascending score, descending with
    ``reverse``; their normalised score is 1.
    """
    frames = [r.df for r in results]
    out = concatenated(frames)
    if not has_sort_keys:
        return out.drop("sort_key_")
    if any("sort_key_" not in f.columns for f in frames):
        raise CatalogError("a result without sort keys can't be merged by them")
    key, rid = F.col("sort_key_"), F.col("data_record_id_")
    order = [key.desc(), rid.desc()] if reverse else [key.asc(), rid.asc()]
    return out.orderBy(*order).drop("sort_key_")
