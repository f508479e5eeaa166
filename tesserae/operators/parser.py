"""The text query language (T10-T13, T29): words, phrases, wildcards, AND, OR, NOT.

A query is a table: alternatives (rows, parted by OR) of conditions (cells, parted by AND or
AND NOT). A cell is a run of atoms, which all must hold, or another table in brackets. An
atom is a word or quoted words; a hyphen before it means that it must not hold. An atom of
several words (quoted, or joined by punctuation) is a phrase. Key words may be in any case.

One pass over the tokens fills the tables, with a stack for brackets. A second pass turns
atoms into words, drops those that the pipeline leaves out, and then what is left empty.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from tesserae.errors import ParseError

_LEX = re.compile(r'[()]|-?(?:"[^"]*"|[^()\s"]+)')


@dataclass(frozen=True)
class Word:
    text: str


@dataclass(frozen=True)
class Glob:
    text: str


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]


@dataclass(frozen=True)
class Not:
    child: Node


@dataclass(frozen=True)
class And:
    children: tuple[Node, ...]


@dataclass(frozen=True)
class Or:
    children: tuple[Node, ...]


Node = Word | Glob | Phrase | Not | And | Or


@dataclass(frozen=True)
class Parsed:
    tree: Node
    ignored: tuple[str, ...]


@dataclass
class _Cell:
    """A condition: a run of atoms, or a table."""

    unwanted: bool
    atoms: list[str] | None = None
    table: list[list[_Cell]] | None = None


def _table(query: str) -> list[list[_Cell]]:
    """First pass: rows of cells."""
    top: list[list[_Cell]] = [[]]
    open_tables, unwanted, before = [top], False, "START"
    for token in _LEX.findall(query):
        key = token.upper()
        key = key if key in ("AND", "OR", "NOT", "(", ")") else "ATOM"
        complete = before in ("ATOM", ")")
        if key == "ATOM" and before == "ATOM":
            open_tables[-1][-1][-1].atoms.append(token)
        elif key in ("ATOM", "(") and not complete:
            cell = _Cell(unwanted, [token]) if key == "ATOM" else _Cell(unwanted, table=[[]])
            open_tables[-1][-1].append(cell)
            unwanted = False
            if key == "(":
                open_tables.append(cell.table)
        elif key == ")" and complete and len(open_tables) > 1:
            open_tables.pop()
        elif key == "OR" and complete:
            open_tables[-1].append([])
        elif key == "NOT" and before == "AND":
            unwanted = True
        elif key != "AND" or not complete:
            raise ParseError(f"{token!r} can't stand {'at the start' if before == 'START' else 'after ' + before} in {query!r}")
        before = key
    if before not in ("ATOM", ")") or len(open_tables) > 1:
        raise ParseError(f"{query!r} isn't complete")
    return top


def _joined(kind: type, nodes: list[Node]) -> Node | None:
    return kind(tuple(nodes)) if len(nodes) > 1 else nodes[0] if nodes else None


def parse(query: str, words_of: Callable[[str], list[str]]) -> Parsed:
    """Parse ``query``; ``words_of`` gives an atom's words, as the index's pipeline does."""
    ignored: list[str] = []

    def run(atoms: list[str]) -> Node | None:
        held, denied = [], []
        for atom in atoms:
            words = words_of(atom)
            if not words:
                ignored.append(atom)
                continue
            one = Glob if set("*?") & set(words[0]) else Word
            (denied if atom.startswith("-") else held).append(Phrase(tuple(words)) if len(words) > 1 else one(words[0]))
        if denied and not held:
            raise ParseError(f"nothing is searched but only excluded by {' '.join(atoms)!r}")
        return _joined(And, [*held, *map(Not, denied)])

    def table(rows: list[list[_Cell]]) -> Node | None:
        kept = []
        for row in rows:
            nodes = [(run(c.atoms) if c.table is None else table(c.table), c.unwanted) for c in row]
            wanted = [x for x, unwanted in nodes if x is not None and not unwanted]
            if wanted:
                kept.append(_joined(And, wanted + [Not(x) for x, unwanted in nodes if x is not None and unwanted]))
        return _joined(Or, kept)

    tree = table(_table(query))
    if tree is None:
        raise ParseError(f"no word of {query!r} is indexed")
    return Parsed(tree, tuple(ignored))


def leaves(node: Node) -> Iterator[Word | Glob | Phrase]:
    """The leaves that can add to a score; those under NOT can't."""
    if isinstance(node, (And, Or)):
        for child in node.children:
            yield from leaves(child)
    elif not isinstance(node, Not):
        yield node


def terms(node: Node) -> list[str]:
    """The words of a query, those under NOT left out."""
    return [w for leaf in leaves(node) for w in (leaf.words if isinstance(leaf, Phrase) else (leaf.text,))]
