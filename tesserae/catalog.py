"""The catalog: a DataFrame, its declared indexes and metadata, and queries over them.

A query compiles to one boolean Column over the ingested table; text adds a join with the
few documents that its words select. Results are lazy DataFrames.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.errors import CatalogError
from tesserae.operators import facets, kinds, sorting
from tesserae.operators.kinds import KINDS, Composite, Kind
from tesserae.operators.textsearch import Inverted, Text
from tesserae.plans import query as q
from tesserae.plans.report import QueryReport
from tesserae.plans.specs import CatalogSpec, column

RID, SCORE, NORMALIZED = "data_record_id_", "data_record_score_", "data_record_normalized_score_"


@dataclass(frozen=True)
class SearchResult:
    """The rows asked for, and all that the query selects."""

    df: DataFrame
    selected: DataFrame
    report: QueryReport | None = None
    key: tuple | None = None

    def actual_result_count(self) -> int:
        """Rows before limit and batch (G14); rows without a sort key don't count."""
        return self.selected.count()

    def collect(self) -> list:
        """The rows, their time counted in the catalog's report."""
        if self.report is None:
            return self.df.collect()
        return self.report.timed(self.key, self.df.collect)

    def objects(self, source: DataFrame, rid: Column | str) -> DataFrame:
        """The source's rows of the result."""
        ids = self.df.select(F.col(RID).alias("__rid"))
        key = source[rid] if isinstance(rid, str) else rid
        return source.join(ids, key == F.col("__rid"), "left_semi")


class Catalog:
    """``rows`` holds rid, uid, the indexes' stored columns (i__name) and metadata (m__name)."""

    def __init__(self, rows: DataFrame, spec: CatalogSpec, report: QueryReport | None = None, inverted: Mapping[str, Inverted] | None = None):
        """``inverted`` holds the stored text indexes of just these rows; a changed catalog has none until it is saved."""
        self.rows, self.spec, self.inverted = rows, spec, dict(inverted or {})
        self.kinds: dict[str, Kind] = {name: KINDS[i.kind](i) for name, i in spec.indexes.items()}
        self.report = report or QueryReport()

    # -- ingest

    @classmethod
    def of(cls, source: DataFrame, spec: CatalogSpec, report: QueryReport | None = None) -> Catalog:
        """Catalog every row of ``source``."""
        return cls(ingest(source, spec), spec, report)

    def with_rows(self, rows: DataFrame) -> Catalog:
        return Catalog(rows, self.spec, self.report)

    def stored_columns(self, name: str) -> list[str]:
        """The columns of ``rows`` that belong to an index."""
        at = self.spec.indexes[name].stored
        return [c for c in self.rows.columns if c == at or c.startswith(f"{at}__")]

    def kind(self, name: str) -> Kind:
        if name not in self.kinds:
            raise CatalogError(f"there is no index {name!r}")
        return self.kinds[name]

    # -- compile

    def compiled(self, request: Mapping) -> tuple[Column | None, list[DataFrame], int]:
        """(predicate, scored tables, indexes used) of a canonical request; None if no index is asked.

        What the other indexes leave is all that is scored.
        """
        request = self._without_composites(request)
        used, predicate, trees = 0, None, []
        for name, kind in self.kinds.items():
            asked = kind.parse(request)
            if asked is None:
                continue
            if isinstance(kind, Text):
                parsed = kind.parsed(asked)
                used += 1
                if parsed is None:
                    predicate = F.lit(False) if predicate is None else predicate & F.lit(False)
                else:
                    trees.append((kind, parsed.tree))
                continue
            used += 1
            own = kind.predicate(asked, self.rows)
            predicate = own if predicate is None else predicate & own
        return predicate, [kind.matches(tree, self.rows, predicate, self.inverted.get(kind.spec.name)) for kind, tree in trees], used

    def _without_composites(self, request: Mapping) -> dict:
        """Queries on a composite index are queries on its components (Q1)."""
        out = dict(request)
        for name, kind in self.kinds.items():
            if isinstance(kind, Composite) and isinstance(out.get(name), Mapping):
                asked = out.pop(name)
                unknown = set(asked) - set(kind.spec.sources)
                if unknown:
                    raise CatalogError(f"index {name!r} has no components {sorted(unknown)}")
                out.update(asked)
        return out

    def selected(self, request: Mapping) -> DataFrame:
        """The ingested rows that a canonical request selects, with ``score`` (null if it has none)."""
        predicate, scored, used = self.compiled(request)
        if not used:
            return self.rows.where(F.lit(False)).withColumn("score", F.lit(None).cast("bigint"))
        rows = self.rows if predicate is None or scored else self.rows.where(predicate)
        if not scored:
            return rows.withColumn("score", F.lit(None).cast("bigint"))
        total = None
        for table in scored:
            total = table if total is None else total.join(table.withColumnRenamed("score", "more"), "rid").select("rid", (F.col("score") + F.col("more")).alias("score"))
        return rows.join(total, "rid")

    # -- search

    def search(self, query: Mapping | None = None, merge: bool = True, compat_set_bonus: bool = False, **more: Any) -> SearchResult:
        """Rows that satisfy all of the query's parts.

        Result columns: the metadata, data_record_id_, data_record_score_ and
        data_record_normalized_score_. An empty query, or one that asks no index, selects
        nothing. Without ``sort_on``, scored results come by descending score, others by id.
        With ``merge=False`` rows carry ``sort_key_`` and aren't ordered, for ``merged``.
        ``compat_set_bonus`` adds 1 to scores for every index without scores in the query.
        """
        request = q.canonical_but(q.merged(query, more), q.SORTING)
        order, window = q.SortOrder.of(request), q.Window.of(request)
        sort_kinds = [self.kind(n) for n in order.names] if order else []
        if order:
            keys, present = sorting.sort_columns(sort_kinds, order.descending)
        rows = self.selected(request)
        scored = any(isinstance(k, Text) and n in request for n, k in self.kinds.items())
        if compat_set_bonus and scored:
            plain = sum(1 for n, k in self.kinds.items() if n in request and not k.scored)
            rows = rows.withColumn("score", F.col("score") + plain)
        metadata = [F.col(f"m__{c}").alias(c) for c in self.spec.columns]
        one = F.lit(1).cast("bigint")
        if order:
            for p in present:
                rows = rows.where(p)
            if not merge:
                key = F.struct(*[k for kind in sort_kinds for k in kind.sort_keys()]) if len(keys) > 2 else sort_kinds[0].sort_keys()[0]
                return SearchResult(rows.select(*metadata, F.col("rid").alias(RID), one.alias(SCORE), one.alias(NORMALIZED), key.alias("sort_key_")), rows)
            out = sorting.windowed(rows.orderBy(*keys), window).select(*metadata, F.col("rid").alias(RID), one.alias(SCORE), one.alias(NORMALIZED))
        elif scored:
            if not merge:
                return SearchResult(rows.select(*metadata, F.col("rid").alias(RID), F.col("score").alias(SCORE), one.alias(NORMALIZED), F.col("score").alias("sort_key_")), rows)
            # The best score is a one-row aggregate, so that no task holds all results.
            ranked = sorting.windowed(rows.orderBy(F.col("score").desc(), F.col("rid").desc()), window)
            if window.start:
                ranked = ranked.withColumn("best", rows.agg(F.max("score")).scalar())
            else:
                # The best of all is among the first; the window holds them all only where no limit was asked.
                ranked = ranked.withColumn("best", (rows if window.stop is None else ranked).agg(F.max("score")).scalar())
            share = F.floor(F.lit(100.0) * F.col("score") / F.col("best")).cast("bigint")
            out = ranked.select(*metadata, F.col("rid").alias(RID), F.col("score").alias(SCORE), F.coalesce(share, one).alias(NORMALIZED)).orderBy(F.col(SCORE).desc(), F.col(RID).desc())
        else:
            if not merge:
                return SearchResult(rows.select(*metadata, F.col("rid").alias(RID), one.alias(SCORE), one.alias(NORMALIZED)), rows)
            limited = window.start or window.stop is not None
            ordered = rows.orderBy("rid") if limited else rows
            out = sorting.windowed(ordered, window).select(*metadata, F.col("rid").alias(RID), one.alias(SCORE), one.alias(NORMALIZED))
        return SearchResult(out, rows, self.report, self.query_key(request))

    __call__ = search

    def search_all(self) -> DataFrame:
        """Every record."""
        one = F.lit(1).cast("bigint")
        return self.rows.select(*[F.col(f"m__{c}").alias(c) for c in self.spec.columns], F.col("rid").alias(RID), one.alias(SCORE), one.alias(NORMALIZED))

    def query_key(self, request: Mapping) -> tuple:
        return self.report.shape(request, [n for n, k in self.kinds.items() if isinstance(k, (kinds.Boolean, kinds.Topic))])

    def explain(self, query: Mapping | None = None, **more: Any) -> None:
        self.search(query, **more).df.explain("formatted")

    # -- text

    def _text(self, name: str) -> Text:
        kind = self.kind(name)
        if not isinstance(kind, Text):
            raise CatalogError(f"index {name!r} isn't a text index")
        return kind

    def query_weight(self, name: str, text: str) -> DataFrame:
        """One row, ``weight``: an upper bound of a query's scores."""
        kind = self._text(name)
        asked = kind.parsed(kind.parse({name: text}))
        if asked is None:
            return self.rows.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("weight"))
        return kind.query_weight(asked.tree, self.rows)

    def ignored_words(self, name: str, text: str) -> tuple[str, ...]:
        """The query's words that the index leaves out."""
        kind = self._text(name)
        return kind.parsed(kind.parse({name: text})).ignored

    def document_words(self, name: str, rid: int) -> DataFrame:
        """A document's words in order."""
        return self.rows.where(F.col("rid") == rid).select(F.posexplode(self._text(name).value).alias("position", "word"))

    def lexicon(self, name: str, glob: str | None = None, start: int = 0, size: int = 100) -> DataFrame:
        """A page of the index's words in order."""
        words = self._text(name).vocabulary(self.rows, glob)
        return sorting.windowed(words.orderBy("word"), q.Window(start, start + size))

    def n_best(self, name: str, text: str, n: int = 10) -> tuple[DataFrame, int]:
        from tesserae.operators.textsearch import n_best

        kind = self._text(name)
        return n_best(kind.matches(kind.parsed(kind.parse({name: text})).tree, self.rows), n)

    # -- facets and statistics

    def unique_values(self, name: str, with_lengths: bool = False, field: str | None = None) -> DataFrame:
        return facets.unique_values(self.kind(name), self.rows, with_lengths, field)

    def has_unique_values(self, name: str) -> bool:
        return facets.has_unique_values(self.kind(name))

    def histogram(self, name: str) -> DataFrame:
        return facets.histogram(self.kind(name), self.rows)

    def num_objects(self, name: str) -> DataFrame:
        return facets.num_objects(self.kind(name), self.rows)

    def index_size(self, name: str) -> DataFrame:
        return facets.index_size(self.kind(name), self.rows)

    def value_to_rids(self, name: str) -> DataFrame:
        return facets.value_to_rids(self.kind(name), self.rows)

    def indexed_rids(self, name: str) -> DataFrame:
        return facets.indexed_rids(self.kind(name), self.rows)

    def key_for_document(self, name: str, rid: int) -> DataFrame:
        keys = self.kind(name).sort_keys()
        return self.rows.where(F.col("rid") == rid).select(keys[0].alias("key"))

    def __len__(self) -> int:
        return self.rows.count()

    # -- records

    def path_of(self, rid: int) -> DataFrame:
        return self.rows.where(F.col("rid") == rid).select("uid")

    def rid_of(self, uid: str) -> DataFrame:
        return self.rows.where(F.col("uid") == uid).select("rid")

    def has_uid(self, uid: str) -> bool:
        return not self.rid_of(uid).isEmpty()

    def metadata(self, rid: int | None = None, uid: str | None = None) -> DataFrame:
        return self._record(rid, uid).select(*[F.col(f"m__{c}").alias(c) for c in self.spec.columns])

    def index_data(self, rid: int | None = None, uid: str | None = None) -> DataFrame:
        """What each index holds for a record, as text, '' where it holds nothing."""
        row = self._record(rid, uid)
        return row.select(*[facets.entry(k, self.rows).alias(n) for n, k in self.kinds.items() if not isinstance(k, Composite)])

    def _record(self, rid: int | None, uid: str | None) -> DataFrame:
        return self.rows.where(F.col("rid") == rid if uid is None else F.col("uid") == uid)

    # -- declarations

    def schema(self) -> list[str]:
        return list(self.spec.columns)

    def indexes(self, kind: str | None = None) -> list[str]:
        return self.spec.named(kind)

    @staticmethod
    def index_kinds() -> list[str]:
        return sorted(KINDS)

    def add_column(self, source: DataFrame, name: str, expr=None, default: Any = None) -> Catalog:
        """A new metadata column, filled from ``source``; null where that has no such record."""
        spec = self.spec.add_column(name, expr, default)
        added = source.select(column(spec.rid).cast("bigint").alias("rid"), spec.columns[name.strip()].value().alias(f"m__{name.strip()}"))
        return replace_rows(self, self.rows.join(added, "rid", "left"), spec)

    def del_column(self, name: str) -> Catalog:
        return replace_rows(self, self.rows.drop(f"m__{name}"), self.spec.del_column(name))

    def add_index(self, source: DataFrame, name: str, kind: str, *sources, **options: Any) -> Catalog:
        """A new index, filled from ``source``."""
        spec = self.spec.add_index(name, kind, *sources, **options)
        own = replace(spec, columns={}, indexes={name.strip(): spec.indexes[name.strip()]})
        return replace_rows(self, self.rows.join(ingest(source, own).drop("uid"), "rid", "left"), spec)

    def del_index(self, name: str) -> Catalog:
        return replace_rows(self, self.rows.drop(*self.stored_columns(name)), self.spec.del_index(name))


def replace_rows(catalog: Catalog, rows: DataFrame, spec: CatalogSpec) -> Catalog:
    return Catalog(rows, spec, catalog.report)


def ingest(source: DataFrame, spec: CatalogSpec) -> DataFrame:
    """The table of a catalog: one select over the source, which Spark prunes to what a query reads."""
    rid = column(spec.rid).cast("bigint")
    uid = rid.cast("string") if spec.uid is None else column(spec.uid).cast("string")
    base = source.withColumn("rid", rid)
    stored: dict[str, Column] = {}
    derived: dict[str, Column] = {}
    names: list[str] = []
    for index in spec.indexes.values():
        kind = KINDS[index.kind](index)
        own, more = kind.stored(base), kind.derived()
        stored.update(own)
        derived.update(more)
        names += [*own, *more]
    rows = base.select("rid", uid.alias("uid"), *[c.alias(n) for n, c in stored.items()], *[c.value().alias(f"m__{n}") for n, c in spec.columns.items()])
    if not derived:
        return rows
    # Spark keeps the second select apart where both a stored column and what is made of it are read.
    return rows.select("rid", "uid", *[derived[n].alias(n) if n in derived else n for n in names], *[f"m__{n}" for n in spec.columns])
