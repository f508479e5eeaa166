"""Text pipelines (T1-T7): from text to an array of words, and for query words in Python alike.

An element has ``column`` for documents (Catalyst expressions only) and ``words`` for the
words of a query; the first element of a pipeline splits text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, digits and underscore in any script: the same set in Java, RE2 and Python's \w.
WORD = r"[\p{L}\p{N}_]+"

#: English words that carry no meaning of their own.
STOP_WORDS = (
    "a", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or",
    "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)


class Splitter:
    """Words are runs of word characters; in queries * and ? may follow."""

    def column(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

    def words(self, text: str, glob: bool = False) -> list[str]:
        return re.findall(r"\w+[\w*?]*" if glob else r"\w+", text)


class HTMLSplitter(Splitter):
    """Lower-cases, then leaves out tags and character references."""

    def column(self, text: Column) -> Column:
        return super().column(F.regexp_replace(F.regexp_replace(F.lower(text), "<[^<>]*>", " "), "&[A-Za-z]+;", " "))

    def words(self, text: str, glob: bool = False) -> list[str]:
        return super().words(re.sub("&[A-Za-z]+;", " ", re.sub("<[^<>]*>", " ", text.lower())), glob)


class CaseNormalizer:
    def column(self, words: Column) -> Column:
        return F.transform(words, F.lower)

    def words(self, words: list[str], glob: bool = False) -> list[str]:
        return [w.lower() for w in words]


@dataclass(frozen=True)
class StopWordRemover:
    """Leaves out stop words, duplicates of other words stay."""

    stop: tuple[str, ...] = STOP_WORDS
    single: bool = False

    def column(self, words: Column) -> Column:
        kept = lambda w: ~w.isin(*self.stop)
        if self.single:
            return F.filter(words, lambda w: kept(w) & ((F.length(w) > 1) | (F.ascii(w) > 254)))
        return F.filter(words, kept)

    def words(self, words: list[str], glob: bool = False) -> list[str]:
        return [w for w in words if w not in self.stop and not (self.single and len(w) == 1 and ord(w) < 255)]


#: Elements by group and name; a pipeline takes at most one of each group.
_ELEMENTS: dict[str, dict[str, Callable[[], object]]] = {}


def register(group: str, name: str, make: Callable[[], object]) -> None:
    if name in _ELEMENTS.setdefault(group, {}):
        raise ValueError(f"there is an element {name!r} in group {group!r} already")
    _ELEMENTS[group][name] = make


def element_groups() -> list[str]:
    return sorted(_ELEMENTS)


def element_names(group: str) -> list[str]:
    return sorted(_ELEMENTS[group])


def element(group: str, name: str) -> object:
    return _ELEMENTS[group][name]()


register("Word Splitter", "Whitespace splitter", Splitter)
register("Word Splitter", "Unicode Whitespace splitter", Splitter)
register("Word Splitter", "HTML aware splitter", HTMLSplitter)
register("Case Normalizer", "Case Normalizer", CaseNormalizer)
register("Case Normalizer", "Unicode Case Normalizer", CaseNormalizer)
register("Stop Words", "Remove listed stop words only", StopWordRemover)
register("Stop Words", "Remove listed and single char words", lambda: StopWordRemover(single=True))
register("Stop Words", "Don't remove stop words", lambda: StopWordRemover(stop=("",)))


@dataclass(frozen=True)
class Pipeline:
    """A splitter and what follows it."""

    elements: tuple

    def column(self, text: Column) -> Column:
        for e in self.elements:
            text = e.column(text)
        return text

    def query_words(self, text: str) -> list[str]:
        """The words of one query term; * and ? stay."""
        words = text
        for e in self.elements:
            words = e.words(words, True)
        return words

    @classmethod
    def of(cls, records: Sequence[tuple[str, str]]) -> Pipeline:
        """From (group, name) pairs; the splitter comes first wherever it is listed."""
        made = [element(*r) for r in records]
        made.sort(key=lambda e: not isinstance(e, Splitter))
        if not made or not isinstance(made[0], Splitter):
            made.insert(0, Splitter())
        return cls(tuple(made))


DEFAULT = Pipeline((Splitter(), CaseNormalizer(), StopWordRemover()))
PLAIN = Pipeline((Splitter(), CaseNormalizer()))
HTML = Pipeline((HTMLSplitter(), StopWordRemover()))
