"""Query shapes, their times, and the slow-query report."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any


@dataclass
class Timing:
    hits: int = 0
    mean: float = 0.0
    last: float = 0.0

    def add(self, seconds: float) -> None:
        self.mean = (self.mean * self.hits + seconds) / (self.hits + 1)
        self.hits, self.last = self.hits + 1, seconds


@dataclass
class QueryReport:
    """Times of queries by shape; those of ``threshold`` seconds or more are reported."""

    threshold: float = 0.1
    #: All shapes seen, and the slow ones.
    plan: dict[tuple, Timing] = field(default_factory=dict)
    slow: dict[tuple, Timing] = field(default_factory=dict)

    @staticmethod
    def shape(request: Mapping, valued: Iterable[str] = ()) -> tuple:
        """What makes two queries alike: the names asked, values only of indexes with few, and negations."""
        plain, marked = [], []
        for name, value in request.items():
            if isinstance(value, Mapping) and "not" in value:
                marked.append((name, "not"))
            elif name in set(valued):
                marked.append((name, repr(value)))
            else:
                plain.append(name)
        return (*sorted(plain), *sorted(marked))

    def timed(self, key: tuple | None, run: Callable[[], Any]) -> Any:
        start = time.perf_counter()
        out = run()
        self.record(key or (), time.perf_counter() - start)
        return out

    def record(self, key: tuple, seconds: float) -> None:
        self.plan.setdefault(key, Timing()).add(seconds)
        if seconds >= self.threshold:
            self.slow.setdefault(key, Timing()).add(seconds)

    def reset(self) -> None:
        self.slow.clear()

    def report(self) -> list[dict]:
        """Slow shapes; durations in milliseconds."""
        return [{"query": k, "counter": t.hits, "duration": t.mean * 1000, "last": {"duration": t.last * 1000}} for k, t in self.slow.items()]

    def dump(self) -> str:
        return json.dumps([[k, [t.hits, t.mean, t.last]] for k, t in self.plan.items()])

    def load(self, text: str) -> None:
        """Take the shapes of a dump; text that isn't one raises ValueError and changes nothing."""
        freeze = lambda k: tuple(freeze(x) if isinstance(x, list) else x for x in k)
        found = {freeze(k): Timing(int(h), float(m), float(last)) for k, (h, m, last) in json.loads(text)}
        self.plan.update(found)

    def load_path(self, path: str | Path) -> None:
        self.load(Path(path).read_text())
