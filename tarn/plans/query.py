"""Structured queries: nodes, the text and dictionary forms, and their reduction to weighted clauses.

Text form: words and operators `#name(...)` separated by white space. #combine (with :INDEX=WEIGHT suffixes), #syn,
#band, #1 (phrase) and #uwN (unordered window of width N). Words are resolved by a function that answers with a term,
STOP (the word is left out everywhere) or UNKNOWN (left out of combine and syn; kills band, phrase and window).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

STOP, UNKNOWN = object(), object()


class QueryError(ValueError):
    """A query that can't be read, or asks for what the index doesn't hold."""


@dataclass(frozen=True)
class Term:
    term: str
    weight: float = 1.0


@dataclass(frozen=True)
class Combine:
    children: tuple[tuple[float, Node], ...]


@dataclass(frozen=True)
class Syn:
    terms: tuple[str, ...]


@dataclass(frozen=True)
class Band:
    children: tuple[Node, ...]


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]


@dataclass(frozen=True)
class Window:
    terms: tuple[str, ...]
    width: int


Node = Term | Combine | Syn | Band | Phrase | Window


# --- text form: first nested lists of marks and words, then nodes


@dataclass
class _Group:
    name: str
    items: list


def _groups(text: str) -> list:
    """Words and groups, nested as the brackets are."""
    top: list = []
    open_groups: list[_Group] = []
    pending: str | None = None
    for mark in re.findall(r"[()]|[^\s()]+", text):
        here = open_groups[-1].items if open_groups else top
        if pending is not None and mark != "(":
            raise QueryError(f"expected '(' after '{pending}', found '{mark}'")
        if mark == "(":
            if pending is None:
                here.append("(")  # a bracket without an operator is a word that no index holds
                continue
            group = _Group(pending, [])
            here.append(group)
            open_groups.append(group)
            pending = None
        elif mark == ")":
            if not open_groups:
                raise QueryError("unexpected ')'")
            open_groups.pop()
        elif mark.startswith("#"):
            pending = mark
        else:
            here.append(mark)
    if pending is not None:
        raise QueryError(f"expected '(' after '{pending}', found the end of the query")
    if open_groups:
        raise QueryError(f"expected ')' to end '{open_groups[-1].name}', found the end of the query")
    return top


def words_of(query: str | dict | int) -> list[str]:
    """The words of a text query that need resolving."""
    found: list[str] = []

    def walk(items: list) -> None:
        for x in items:
            walk(x.items) if isinstance(x, _Group) else found.append(x)

    if isinstance(query, str):
        walk(_groups(query))
    return found


class _Reader:
    def __init__(self, resolve: Callable[[str], object]):
        self.resolve = resolve

    def node(self, item: str | _Group) -> object:
        """A node, STOP or UNKNOWN."""
        if isinstance(item, str):
            got = self.resolve(item)
            return Term(got) if isinstance(got, str) else got
        name, *weights = item.name[1:].split(":")
        window = re.fullmatch(r"uw([0-9]+)", name)
        if weights and name != "combine":
            raise QueryError(f"'{item.name}': only #combine takes weights")
        if name == "combine":
            return self.combine(item, weights)
        if name == "band":
            children = [c for c in map(self.node, item.items) if c is not STOP]
            return UNKNOWN if UNKNOWN in children or not children else Band(tuple(children))
        if name == "syn":
            terms = [t for t in self.terms(item) if isinstance(t, str)]
            return Syn(tuple(terms)) if terms else UNKNOWN
        if name == "1" or window:
            width = int(window[1]) if window else 0
            if window and width < 2:
                raise QueryError(f"window width must be at least 2, got {width} (in '{item.name}')")
            terms = [t for t in self.terms(item) if t is not STOP]
            if UNKNOWN in terms or not terms:
                return UNKNOWN
            return Window(tuple(terms), width) if window else Phrase(tuple(terms))
        raise QueryError(f"unknown operator '{item.name}'")

    def terms(self, item: _Group) -> list:
        for x in item.items:
            if isinstance(x, _Group):
                raise QueryError(f"operator '{x.name}' not allowed inside {item.name}")
        return [self.resolve(x) for x in item.items]

    def combine(self, item: _Group, weights: list[str]) -> object:
        given: dict[int, float] = {}
        for w in weights:
            m = re.fullmatch(r"([0-9]+)=([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)", w)
            if not m:
                raise QueryError(f"malformed combine weight '{w}' in '{item.name}'")
            given[int(m[1])] = float(m[2])
        children = [(given.get(i, 1.0), self.node(x)) for i, x in enumerate(item.items)]
        children = [(w, c) for w, c in children if c is not STOP and c is not UNKNOWN]
        return Combine(tuple(children)) if children else UNKNOWN


def parse(text: str, resolve: Callable[[str], object]) -> Node:
    """The node of a text query; an empty Combine where nothing is left."""
    reader = _Reader(resolve)
    children = [c for c in map(reader.node, _groups(text)) if c is not STOP and c is not UNKNOWN]
    return children[0] if len(children) == 1 else Combine(tuple((1.0, c) for c in children))


# --- dictionary form


def _term(value: object) -> str:
    if isinstance(value, bool) or not isinstance(value, int | str):
        raise QueryError(f"a term must be a number or a word, got {value!r}")
    return str(value)


def _terms(value: object, of: str) -> tuple[str, ...]:
    if not isinstance(value, list | tuple):
        raise QueryError(f"'{of}' needs a list of terms")
    return tuple(map(_term, value))


def from_dict(query: dict | int | str) -> Node:
    """The node of a term, or of a dictionary with the one key term, combine, syn, band, phrase or window."""
    if isinstance(query, int | str) and not isinstance(query, bool):
        return Term(_term(query))
    if not isinstance(query, dict):
        raise QueryError("a query node is a term or a dictionary with one key")
    if len(query) != 1:
        raise QueryError(f"a query dictionary has exactly one key, got {len(query)}")
    ((key, value),) = query.items()
    if key == "term":
        if isinstance(value, list | tuple):
            if len(value) != 2 or isinstance(value[1], bool) or not isinstance(value[1], int | float):
                raise QueryError("'term' needs a term or a [term, weight] pair")
            return Term(_term(value[0]), float(value[1]))
        return Term(_term(value))
    if key == "combine":
        if not isinstance(value, list | tuple) or any(not isinstance(p, list | tuple) or len(p) != 2 or isinstance(p[0], bool) or not isinstance(p[0], int | float) for p in value):
            raise QueryError("'combine' needs a list of [weight, node] pairs")
        return Combine(tuple((float(w), from_dict(n)) for w, n in value))
    if key == "band":
        if not isinstance(value, list | tuple):
            raise QueryError("'band' needs a list of nodes")
        return Band(tuple(map(from_dict, value)))
    if key in ("syn", "phrase"):
        return (Syn if key == "syn" else Phrase)(_terms(value, key))
    if key == "window":
        if not isinstance(value, dict) or not {"terms", "width"} <= set(value):
            raise QueryError("'window' needs a dictionary with 'terms' and 'width'")
        if isinstance(value["width"], bool) or not isinstance(value["width"], int):
            raise QueryError("'window' needs a whole number as its width")
        return Window(_terms(value["terms"], key), value["width"])
    raise QueryError(f"unknown query operator '{key}', expected one of: term, combine, syn, band, phrase, window")


# --- checks and reduction


def is_empty(node: Node) -> bool:
    """Whether an operator somewhere has nothing to work on."""
    match node:
        case Combine(children):
            return not children or any(is_empty(c) for _, c in children)
        case Band(children):
            return not children or any(map(is_empty, children))
        case Syn(terms) | Phrase(terms) | Window(terms):
            return not terms
    return False


def validate(node: Node) -> None:
    match node:
        case Combine(children):
            for _, c in children:
                validate(c)
        case Band(children):
            for c in children:
                if isinstance(c, Combine):
                    raise QueryError("#combine can only stand at the top or inside another #combine")
                validate(c)
        case Window(_, width) if width < 2:
            raise QueryError(f"window width must be at least 2, got {width}")


def clauses(node: Node) -> list[tuple[float, Node]]:
    """What stands under combines, with weights multiplied along the way; like clauses become one, with summed weights."""
    found: dict[Node, float] = {}

    def walk(n: Node, w: float) -> None:
        if isinstance(n, Combine):
            for cw, c in n.children:
                walk(c, w * cw)
        elif isinstance(n, Term):
            found[Term(n.term)] = found.get(Term(n.term), 0.0) + w * n.weight
        else:
            found[n] = found.get(n, 0.0) + w

    walk(node, 1.0)
    return [(w, n) for n, w in found.items()]


def needs_positions(node: Node) -> bool:
    match node:
        case Combine(children):
            return any(needs_positions(c) for _, c in children)
        case Band(children):
            return any(map(needs_positions, children))
    return isinstance(node, Phrase | Window)
