"""Declarations: which columns a catalog keeps, and which indexes it can be asked."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.errors import CatalogError

#: A source: a column's name, or a function that gives a Column (a computed attribute).
Source = str | Callable[[], Column]


def column(source: Source) -> Column:
    return F.col(source) if isinstance(source, str) else source()


@dataclass(frozen=True)
class ColumnSpec:
    """Metadata that results carry; ``default`` replaces null, None and '' mean none."""

    name: str
    source: Source
    default: Any = None

    def value(self) -> Column:
        value = column(self.source)
        return value if self.default in (None, "") else F.coalesce(value, F.lit(self.default))


@dataclass(frozen=True)
class IndexSpec:
    """An index: its kind, what it reads, and the kind's options.

    Several sources: the last that has a value wins, or for text, all are joined.
    """

    name: str
    kind: str
    sources: tuple[Source, ...]
    options: Mapping[str, Any] = field(default_factory=dict)

    @property
    def stored(self) -> str:
        return f"i__{self.name}"


@dataclass(frozen=True)
class CatalogSpec:
    """What a catalog reads as record id and uid, its metadata columns and its indexes."""

    rid: Source
    uid: Source | None = None
    columns: Mapping[str, ColumnSpec] = field(default_factory=dict)
    indexes: Mapping[str, IndexSpec] = field(default_factory=dict)

    def add_column(self, name: str, source: Source | None = None, default: Any = None) -> CatalogSpec:
        name = name.strip()
        if not name or name.startswith("_"):
            raise CatalogError(f"a column can't be named {name!r}")
        if name in self.columns:
            raise CatalogError(f"there is a column {name!r} already")
        return replace(self, columns={**self.columns, name: ColumnSpec(name, name if source is None else source, default)})

    def del_column(self, name: str) -> CatalogSpec:
        if name not in self.columns:
            raise CatalogError(f"there is no column {name!r}")
        return replace(self, columns={k: v for k, v in self.columns.items() if k != name})

    def add_index(self, name: str, kind: str, *sources: Source, **options: Any) -> CatalogSpec:
        from tesserae.operators.kinds import KINDS

        name = name.strip()
        if not name or name.startswith("_"):
            raise CatalogError(f"an index can't be named {name!r}")
        if name in self.indexes:
            raise CatalogError(f"there is an index {name!r} already")
        if kind not in KINDS:
            raise CatalogError(f"there is no index kind {kind!r}; there are {', '.join(sorted(KINDS))}")
        return replace(self, indexes={**self.indexes, name: IndexSpec(name, kind, sources or (name,), options)})

    def del_index(self, name: str) -> CatalogSpec:
        if name not in self.indexes:
            raise CatalogError(f"there is no index {name!r}")
        return replace(self, indexes={k: v for k, v in self.indexes.items() if k != name})

    def with_options(self, name: str, **options: Any) -> CatalogSpec:
        """The index ``name`` with changed options, e.g. a topic index's sets."""
        index = self.indexes[name]
        return replace(self, indexes={**self.indexes, name: replace(index, options={**index.options, **options})})

    def named(self, kind: str | None = None) -> list[str]:
        return [n for n, i in self.indexes.items() if kind in (None, i.kind)]
