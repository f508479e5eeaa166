"""Dictionary queries, brought to one form."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from tesserae.errors import CatalogError


def merged(query: Mapping | None, more: Mapping) -> dict:
    """A query and keyword arguments; the latter win."""
    return {**(query or {}), **more}


def canonical(query: Mapping) -> dict:
    """Top-level lists and tuples become sorted lists, where their values compare."""
    out = {}
    for name, value in query.items():
        if isinstance(value, (list, tuple)):
            try:
                value = sorted(value)
            except TypeError as e:
                raise TypeError(f"{name!r}: values of one query must be of comparable types") from e
        out[name] = value
    return out


def _listed(value: Any) -> list:
    return list(value) if isinstance(value, (list, tuple)) else [value]


@dataclass(frozen=True)
class IndexQuery:
    """What a query asks of one index."""

    name: str
    keys: tuple = ()
    options: Mapping[str, Any] = field(default_factory=dict)
    operator: str = "or"

    @property
    def nots(self) -> tuple:
        return tuple(self.options.get("not", ()))

    @property
    def range(self) -> frozenset[str]:
        """Of "min" and "max", those that the range names; the old spelling is usage "range:min:max"."""
        spelled = str(self.options.get("range") or "")
        usage = str(self.options.get("usage") or "").lower()
        if usage.startswith("range"):
            spelled += usage
        return frozenset(x for x in ("min", "max") if x in spelled)

    @classmethod
    def of(cls, request: Mapping, name: str, allowed: Iterable[str], operators: Iterable[str] = ("or",), default: str = "or") -> IndexQuery | None:
        """The part of ``request`` for the index ``name``; None if there is none.

        A dict gives ``query`` and options. Beside any other value, keys ``name_xxx`` of
        the request are its options, whatever else they may have been meant for.
        """
        if name not in request:
            return None
        value = request[name]
        if isinstance(value, Mapping):
            keys, given = _listed(value.get("query", ())), {k: v for k, v in value.items() if k != "query"}
        else:
            keys, given = _listed(value), {k[len(name) + 1 :]: v for k, v in request.items() if k.startswith(f"{name}_")}
        for option in given:
            if option not in set(allowed):
                raise ValueError(f"index {name!r}: option {option!r} is not valid")
        operator = str(given.pop("operator", default)).lower()
        if operator not in set(operators):
            raise ValueError(f"index {name!r}: operator {operator!r} is not valid")
        if given.get("not") is None:
            given.pop("not", None)
        else:
            given["not"] = _listed(given["not"])
        return cls(name, tuple(keys), given, operator)


def sort_option(query: Mapping, name: str) -> Any:
    """``sort-name``, else ``sort_name``."""
    return query.get(f"sort-{name}", query.get(f"sort_{name}"))


@dataclass(frozen=True)
class SortOrder:
    """Index names and whether each is descending."""

    names: tuple[str, ...]
    descending: tuple[bool, ...]

    @classmethod
    def of(cls, query: Mapping) -> SortOrder | None:
        on, order = sort_option(query, "on"), sort_option(query, "order")
        if on is None:
            return None
        names = tuple(_listed(on))
        if any(not isinstance(n, str) for n in names):
            raise CatalogError(f"sort_on must name indexes, not {on!r}")
        down = [str(o).lower() in ("reverse", "descending") for o in _listed("" if order is None else order)]
        # One direction for all, or one each: surplus directions go, missing ones ascend.
        if len(down) == 1:
            down *= len(names)
        down = (down + [False] * len(names))[: len(names)]
        return cls(names, tuple(down))


@dataclass(frozen=True)
class Window:
    """Which rows of the sorted result are wanted: [start, stop), stop None for all."""

    start: int = 0
    stop: int | None = None

    @classmethod
    def of(cls, query: Mapping) -> Window:
        start, size, limit = int(query.get("b_start") or 0), query.get("b_size"), sort_option(query, "limit")
        if size is not None:
            # A negative start is a window that begins before the first row.
            return cls(max(0, start), max(0, start + int(size)))
        if limit is not None:
            limit = int(limit)
            return cls(max(0, start), max(0, start) + limit)
        return cls(max(0, start))


#: Entries of a request that order and cut the result; their lists keep their order.
SORTING = ("sort_on", "sort-on", "sort_order", "sort-order", "sort_limit", "sort-limit")


def canonical_but(query: Mapping, names: Iterable[str]) -> dict:
    """``canonical``, the entries ``names`` left alone."""
    names = set(names)
    return {**canonical({k: v for k, v in query.items() if k not in names}), **{k: v for k, v in query.items() if k in names}}
