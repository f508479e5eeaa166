"""Distinct values, counts, histograms and index contents (G)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.errors import CatalogError
from tesserae.operators.kinds import UUID, Boolean, DateRange, Keyword, Kind, Path, Topic
from tesserae.operators.textsearch import Text


def _values(kind: Kind, rows: DataFrame) -> DataFrame:
    """(value, rid), a row for each value that a record is indexed under."""
    if isinstance(kind, Topic):
        names = F.array(*[F.when(kind.member(n), F.lit(n)) for n in kind.sets])
        return rows.select(F.explode(F.filter(names, lambda x: x.isNotNull())).alias("value"), "rid")
    if isinstance(kind, Path):
        return rows.where(kind.indexed).select(F.explode(F.array_distinct(F.col(kind.parts))).alias("value"), "rid")
    if isinstance(kind, Keyword):
        return rows.select(F.explode(kind.value).alias("value"), "rid")
    return rows.where(kind.indexed).select(kind.value.alias("value"), "rid")


def has_unique_values(kind: Kind) -> bool:
    return kind.unique_values


def unique_values(kind: Kind, rows: DataFrame, with_lengths: bool = False, field: str | None = None) -> DataFrame:
    """``value``, and with ``with_lengths`` ``count``, of an index.

    A boolean index always gives both values. A date range gives the bounds of ``field``
    ("since" or "until"), those of closed and half-open ranges apart.
    """
    if not kind.unique_values:
        raise NotImplementedError(f"index {kind.spec.name!r} has no unique values")
    if isinstance(kind, Boolean):
        both = rows.agg(F.count(F.when(kind.value == F.lit(False), 1)).alias("n0"), F.count(F.when(kind.value, 1)).alias("n1"))
        out = both.select(F.explode(F.array(*[F.struct(F.lit(bool(i)).alias("value"), F.col(f"n{i}").alias("count")) for i in (0, 1)])).alias("v")).select("v.*")
    elif isinstance(kind, DateRange):
        if field not in (None, "since", "until"):
            return rows.limit(0).select(F.lit(None).cast("bigint").alias("value"), F.lit(0).cast("bigint").alias("count")).select("value", *["count"] * with_lengths)
        own, other = (kind.since, kind.until) if field != "until" else (kind.until, kind.since)
        out = rows.where(F.col(own).isNotNull()).groupBy(F.col(own).alias("value"), F.col(other).isNull().alias("open")).agg(F.count(F.lit(1)).alias("count")).drop("open")
    elif isinstance(kind, UUID):
        out = _values(kind, rows).select("value", F.lit(1).cast("bigint").alias("count"))
    elif isinstance(kind, Topic):
        sums = rows.agg(*[F.coalesce(F.sum(kind.member(n).cast("bigint")), F.lit(0)).alias(f"n{i}") for i, n in enumerate(kind.sets)])
        out = sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("value"), F.col(f"n{i}").alias("count")) for i, n in enumerate(kind.sets)])).alias("v")).select("v.*")
    else:
        out = _values(kind, rows).groupBy("value").agg(F.count(F.lit(1)).alias("count"))
    if with_lengths:
        return out
    return out.select("value") if isinstance(kind, DateRange) else out.select("value").distinct()


def histogram(kind: Kind, rows: DataFrame) -> DataFrame:
    """How many values have how many records: (size, n_values); of a boolean index (value, count)."""
    if isinstance(kind, Boolean):
        return unique_values(kind, rows, True)
    sizes = _values(kind, rows).groupBy("value").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n_values"))


def num_objects(kind: Kind, rows: DataFrame) -> DataFrame:
    """One row, ``n``: the records in the index; of a text index its words, as the names are swapped there."""
    if isinstance(kind, Text):
        return kind.vocabulary(rows).agg(F.count(F.lit(1)).alias("n"))
    if isinstance(kind, UUID):
        return rows.agg(F.count(kind.value).alias("n"))
    return rows.where(kind.indexed).agg(F.count(F.lit(1)).alias("n"))


def index_size(kind: Kind, rows: DataFrame) -> DataFrame:
    """One row, ``n``: the distinct values; of a boolean index 2, of a text index its documents."""
    if isinstance(kind, Text):
        return rows.where(kind.indexed).agg(F.count(F.lit(1)).alias("n"))
    if isinstance(kind, Boolean):
        return rows.sparkSession.range(1).select(F.lit(2).cast("bigint").alias("n"))
    if isinstance(kind, DateRange):
        return rows.agg(F.count_distinct(F.struct(kind.since, kind.until)).alias("n"))
    return _values(kind, rows).agg(F.count_distinct("value").alias("n"))


def value_to_rids(kind: Kind, rows: DataFrame) -> DataFrame:
    """(value, rid): the index browser's listing (G15), a row for each value and record."""
    if isinstance(kind, Text) or isinstance(kind, DateRange):
        raise CatalogError(f"index {kind.spec.name!r} lists no values")
    return _values(kind, rows)


def indexed_rids(kind: Kind, rows: DataFrame) -> DataFrame:
    return rows.where(kind.indexed).select("rid")


def entry(kind: Kind, rows: DataFrame) -> Column:
    """What the index holds for a record, as text; '' if nothing."""
    if isinstance(kind, Topic):
        return F.array_join(F.filter(F.array(*[F.when(kind.member(n), F.lit(n)) for n in kind.sets]), lambda x: x.isNotNull()), " ")
    if isinstance(kind, DateRange):
        return F.concat_ws(" ", F.coalesce(F.col(kind.since).cast("string"), F.lit("")), F.coalesce(F.col(kind.until).cast("string"), F.lit("")))
    if isinstance(kind, (Keyword, Text)):
        return F.coalesce(F.array_join(kind.value.cast("array<string>"), " "), F.lit(""))
    return F.coalesce(kind.value.cast("string"), F.lit(""))
