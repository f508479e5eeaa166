"""Index kinds (P, I): each compiles its part of a query to one boolean Column.

A kind says which columns it stores for a row and how a query on them reads. Nothing is
looked up outside of Spark: the two predicates that depend on other rows (a pure
negation, and "all values in a range") use scalar subqueries, so that a query stays one
lazy plan.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.errors import CatalogError
from tesserae.functions import dates, scalars
from tesserae.plans.query import IndexQuery
from tesserae.plans.specs import IndexSpec, column

def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


class Kind:
    """What all kinds share; ``spec`` is an IndexSpec, ``rows`` the catalog's ingested table."""

    options: tuple[str, ...] = ("query", "range", "not")
    operators: tuple[str, ...] = ("or",)
    default_operator = "or"
    #: Facets and sorting.
    unique_values = True
    sortable = True
    #: Whether matches carry scores.
    scored = False

    def __init__(self, spec: IndexSpec):
        self.spec = spec
        self.at = spec.stored

    # -- ingest

    def _winner(self, df: DataFrame) -> tuple[Column, str]:
        """The last source that has a value, and its type."""
        values = [column(s) for s in self.spec.sources]
        kind = df.select(values[-1].alias("x")).dtypes[0][1]
        return (values[0] if len(values) == 1 else F.coalesce(*reversed(values))), kind

    def stored(self, df: DataFrame) -> dict[str, Column]:
        return {self.at: self._winner(df)[0]}

    def derived(self) -> dict[str, Column]:
        """Columns made of the stored ones, which aren't computed again for them."""
        return {}

    def convert(self, key: Any) -> Any:
        return key

    # -- the index's own columns

    @property
    def value(self) -> Column:
        return F.col(self.at)

    @property
    def indexed(self) -> Column:
        return self.value.isNotNull()

    def sort_keys(self) -> list[Column]:
        if not self.sortable:
            raise CatalogError(f"index {self.spec.name!r} can't sort")
        return [self.value]

    # -- queries

    def parse(self, request: Mapping) -> IndexQuery | None:
        return IndexQuery.of(request, self.spec.name, (*self.options, *self.spec.options.get("query_options", ())), self.operators, self.default_operator)

    def has_any(self, keys: list) -> Column:
        return self.value.isin(*keys) if keys else F.lit(False)

    def has_all(self, keys: list) -> Column:
        return self.has_any(keys[:1]) & _all([self.has_any([k]) for k in keys[1:]])

    def in_range(self, low: Any, high: Any) -> Column:
        out = self.indexed
        if low is not None:
            out = self.value >= F.lit(low)
        if high is not None:
            out = (self.value <= F.lit(high)) if low is None else out & (self.value <= F.lit(high))
        return out

    def all_in_range(self, rows: DataFrame, low: Any, high: Any) -> Column:
        """Rows in every value set within the range: a single-valued row only if there is one value."""
        inside = self.in_range(low, high)
        return inside & (rows.where(inside).agg(F.count_distinct(self.value)).scalar() == 1)

    def least_and_greatest(self, rows: DataFrame, nots: list) -> tuple[Column, Column]:
        """Smallest and greatest indexed value that isn't excluded."""
        rest = rows.where(self.indexed & ~self.has_any(nots)) if nots else rows.where(self.indexed)
        return rest.agg(F.min(self.value)).scalar(), rest.agg(F.max(self.value)).scalar()

    def predicate(self, query: IndexQuery, rows: DataFrame) -> Column:
        """The rows that the query on this index selects."""
        keys = [self.convert(k) for k in query.keys if k is not None]
        nots = [x for x in (self.convert(k) for k in query.nots if k is not None) if x is not None]
        keys = [k for k in keys if k is not None]
        excluded = F.coalesce(self.has_any(nots), F.lit(False))
        if not query.keys and query.nots and not query.range:
            # With something to exclude, all other rows match, those without a value included;
            # with nothing to exclude, the rows that have a value.
            some = F.coalesce(rows.agg(F.bool_or(excluded)).scalar(), F.lit(False))
            return F.when(some, ~excluded).otherwise(self.indexed)
        if query.range:
            if keys:
                low, high = min(keys), max(keys)
            elif query.nots:
                low, high = self.least_and_greatest(rows, nots)
            else:
                raise ValueError(f"index {query.name!r}: a range needs values")
            low = low if "min" in query.range else None
            # A bound of 0 or '' is no upper bound.
            high = high if "max" in query.range and (isinstance(high, Column) or high) else None
            inside = self.all_in_range(rows, low, high) if query.operator == "and" else self.in_range(low, high)
        elif query.operator == "and":
            inside = self.has_all(keys) if keys else F.lit(False)
        else:
            inside = self.has_any(keys)
        return inside & ~excluded if nots else inside


class Field(Kind):
    """One orderable value."""


class Keyword(Kind):
    """A set of values (I2): an array, a single value counting as an array of one."""

    options = ("query", "range", "not", "operator")
    operators = ("or", "and")

    def stored(self, df: DataFrame) -> dict[str, Column]:
        value, kind = self._winner(df)
        if not kind.startswith("array"):
            value = F.when(scalars.truth(value, kind), F.array(value))
        values = F.filter(F.array_distinct(value), lambda x: x.isNotNull())
        return {self.at: F.when(F.size(values) > 0, values)}

    def has_any(self, keys: list) -> Column:
        if not keys:
            return F.lit(False)
        if len(keys) == 1:
            return F.array_contains(self.value, keys[0])
        return F.arrays_overlap(self.value, F.array(*[F.lit(k) for k in keys]))

    def has_all(self, keys: list) -> Column:
        return _all([F.array_contains(self.value, k) for k in dict.fromkeys(keys)])

    @staticmethod
    def _between(x: Column, low: Any, high: Any) -> Column:
        out = F.lit(True)
        if low is not None:
            out = x >= F.lit(low) if not isinstance(low, Column) else x >= low
        if high is not None:
            bound = x <= (high if isinstance(high, Column) else F.lit(high))
            out = out & bound if low is not None else bound
        return out

    def in_range(self, low: Any, high: Any) -> Column:
        return F.exists(self.value, lambda x: self._between(x, low, high)) if low is not None or high is not None else self.indexed

    def all_in_range(self, rows: DataFrame, low: Any, high: Any) -> Column:
        each = rows.select(F.explode(self.value).alias("v"))
        wanted = each.where(self._between(F.col("v"), low, high)).agg(F.count_distinct("v")).scalar()
        own = F.size(F.filter(self.value, lambda x: self._between(x, low, high)))
        return (own == wanted) & (own > 0)

    def least_and_greatest(self, rows: DataFrame, nots: list) -> tuple[Column, Column]:
        each = rows.select(F.explode(self.value).alias("v"))
        each = each.where(~F.col("v").isin(*nots)) if nots else each
        return each.agg(F.min("v")).scalar(), each.agg(F.max("v")).scalar()


class Boolean(Kind):
    """Truth of a value (I3); only the first key counts.

    A null isn't indexed, unless the option ``present`` (a source) says that the attribute
    is there: then null is false.
    """

    options = ("query",)

    def stored(self, df: DataFrame) -> dict[str, Column]:
        value, kind = self._winner(df)
        value = scalars.truth(value, kind)
        if "present" in self.spec.options:
            value = F.when(column(self.spec.options["present"]), F.coalesce(value, F.lit(False)))
        return {self.at: value}

    def parse(self, request: Mapping) -> IndexQuery | None:
        # A negation is accepted for the sake of old queries, and doesn't count.
        value = request.get(self.spec.name)
        if isinstance(value, Mapping) and set(value) == {"not"}:
            return IndexQuery(self.spec.name, (), {"not": value["not"] if isinstance(value["not"], (list, tuple)) else [value["not"]]})
        return super().parse(request)

    def predicate(self, query: IndexQuery, rows: DataFrame) -> Column:
        if not query.keys:
            if query.nots:
                return self.value == F.lit(not query.nots[0])
            return F.lit(False)
        return self.value == F.lit(bool(query.keys[0]))


class Date(Kind):
    """A point in time as a minute code (I4). Options: precision (minutes), local (time zone of naive times)."""

    def stored(self, df: DataFrame) -> dict[str, Column]:
        value, kind = self._winner(df)
        return {self.at: dates.minute_code_column(value, kind, self.spec.options.get("precision", 1), self.spec.options.get("local"))}

    def convert(self, key: Any) -> int | None:
        from zoneinfo import ZoneInfo

        local = self.spec.options.get("local")
        return dates.minute_code(key, self.spec.options.get("precision", 1), ZoneInfo(local) if local else None)


class DateRange(Kind):
    """An interval of minutes, either side open (I5): matches the times within it.

    Sources: since, until. Options: floor, ceiling (values beyond leave the side open), precision.
    """

    options = ("query",)

    def __init__(self, spec: IndexSpec):
        super().__init__(spec)
        if len(spec.sources) != 2:
            raise CatalogError(f"index {spec.name!r} needs two sources, since and until")
        self.since, self.until = f"{self.at}__since", f"{self.at}__until"

    def stored(self, df: DataFrame) -> dict[str, Column]:
        out = {}
        for name, source in zip((self.since, self.until), self.spec.sources, strict=True):
            kind = df.select(column(source).alias("x")).dtypes[0][1]
            o = self.spec.options
            out[name] = dates.epoch_minutes_column(column(source), kind, o.get("precision", 1), o.get("floor"), o.get("ceiling"))
        return out

    @property
    def indexed(self) -> Column:
        return F.lit(True)

    def sort_keys(self) -> list[Column]:
        return [F.struct(F.col(self.since), F.col(self.until))]

    def convert(self, key: Any) -> int | None:
        minutes = dates.epoch_minutes(key, self.spec.options.get("precision", 1))
        low, high = self.spec.options.get("floor"), self.spec.options.get("ceiling")
        if minutes is None or low is not None and minutes < low or high is not None and minutes > high:
            return None
        return minutes

    def predicate(self, query: IndexQuery, rows: DataFrame) -> Column:
        if not query.keys:
            return F.lit(False)
        t = self.convert(query.keys[0])
        if t is None:  # outside of all that can be indexed
            return F.lit(True)
        since, until = F.col(self.since), F.col(self.until)
        return (since.isNull() | (since <= t)) & (until.isNull() | (until >= t))


class Path(Kind):
    """A path by its components (I6): a run of them at a level, or at any if the level is negative."""

    options = ("query", "level", "operator")
    operators = ("or", "and")

    def __init__(self, spec: IndexSpec):
        super().__init__(spec)
        self.parts = f"{self.at}__parts"

    def stored(self, df: DataFrame) -> dict[str, Column]:
        value, kind = self._winner(df)
        if kind.startswith("array"):
            value = F.concat(F.lit("/"), F.array_join(F.filter(value, lambda x: x != ""), "/"))
        return {self.at: value, self.parts: scalars.components(value)}

    def _match(self, path: str, level: int) -> Column:
        wanted, parts = scalars.path_components(path), F.col(self.parts)
        if not wanted:
            return self.indexed
        at = lambda i: _all([F.get(parts, i + n) == w for n, w in enumerate(wanted)])
        if level >= 0:
            return F.coalesce(at(F.lit(level)), F.lit(False))
        if len(wanted) == 1:
            return F.array_contains(parts, wanted[0])
        run = F.lit("/" + "/".join(wanted) + "/")
        # Components hold no slash, so the run stands in the path just where it stands in the text.
        return F.contains(F.concat(F.lit("/"), F.array_join(parts, "/"), F.lit("/")), run)

    def predicate(self, query: IndexQuery, rows: DataFrame) -> Column:
        level = int(query.options.get("level", 0))
        each = [self._match(k, level) if isinstance(k, str) else self._match(k[0], int(k[1])) for k in query.keys if k is not None]
        if not each:
            return F.lit(False)
        return _all(each) if query.operator == "and" else _any(each)


class Topic(Kind):
    """Named sets, each a boolean SQL expression (I7). Option: sets, {name: expression}.

    Unknown names are ignored. An expression that gives null leaves the row out.
    """

    options = ("query", "operator")
    operators = ("or", "and")
    sortable = False

    @property
    def sets(self) -> Mapping[str, str]:
        return self.spec.options.get("sets", {})

    def member(self, name: str) -> Column:
        return F.col(f"{self.at}__{name}")

    def stored(self, df: DataFrame) -> dict[str, Column]:
        return {f"{self.at}__{n}": F.coalesce(F.expr(e).cast("boolean"), F.lit(False)) for n, e in self.sets.items()}

    @property
    def indexed(self) -> Column:
        return _any([self.member(n) for n in self.sets])

    def predicate(self, query: IndexQuery, rows: DataFrame) -> Column:
        known = [self.member(n) for n in query.keys if n in self.sets]
        if not known:
            return F.lit(False)
        return _all(known) if query.operator == "and" else _any(known)


class UUID(Kind):
    """A unique value (I8): of rows with the same one, the first catalogued is found by it; all sort by it.

    Of rows that are catalogued together that is the one of smallest rid.
    """

    def __init__(self, spec: IndexSpec):
        super().__init__(spec)
        self.first = f"{self.at}__first"

    def stored(self, df: DataFrame) -> dict[str, Column]:
        value, _ = self._winner(df)
        # Pruned unless a query asks for it; filters on the value go below the window.
        return {self.at: value, self.first: self.is_first(value)}

    @staticmethod
    def is_first(value: Column, before: Column | None = None) -> Column:
        """Whether a row is found by its value: the one that was so ``before``, else that of the smallest rid."""
        # Rows without a value are no group, which one task would have to sort.
        group = Window.partitionBy(value, F.when(value.isNull(), F.col("rid")))
        order = ["rid"] if before is None else [before.desc_nulls_last(), "rid"]
        return F.row_number().over(group.orderBy(*order)) == 1

    @property
    def indexed(self) -> Column:
        return self.value.isNotNull() & F.col(self.first)

    def has_any(self, keys: list) -> Column:
        return super().has_any(keys) & F.col(self.first)

    def in_range(self, low: Any, high: Any) -> Column:
        return super().in_range(low, high) & F.col(self.first)


class Composite(Kind):
    """Several indexes as one (I9). Sources name the components.

    A conjunction of its components' queries is what it answers; Spark pushes the filters
    down together, so there is nothing to precompute and it stores nothing.
    """

    options = ("query", "operator", "not")
    sortable = False
    unique_values = False

    def stored(self, df: DataFrame) -> dict[str, Column]:
        return {}

    @property
    def indexed(self) -> Column:
        return F.lit(True)

    def parse(self, request: Mapping) -> IndexQuery | None:
        return IndexQuery(self.spec.name, tuple(request[self.spec.name])) if self.spec.name in request else None

    def predicate(self, query: IndexQuery, rows: DataFrame) -> Column:
        raise CatalogError("a composite index is queried through the catalog")


#: Kinds by name; ``register_kind`` adds others.
KINDS: dict[str, type[Kind]] = {
    "field": Field, "keyword": Keyword, "boolean": Boolean, "date": Date, "daterange": DateRange, "path": Path, "topic": Topic, "uuid": UUID, "composite": Composite,
}


def register_kind(name: str, kind: type[Kind]) -> None:
    if name in KINDS:
        raise CatalogError(f"there is an index kind {name!r} already")
    KINDS[name] = kind
