"""Query trees: what a query means, before it becomes columns."""

from __future__ import annotations

from dataclasses import dataclass

MUST, SHOULD, MUST_NOT, FILTER = "MUST", "SHOULD", "MUST_NOT", "FILTER"


class Node:
    pass


@dataclass(frozen=True)
class Everything(Node):
    pass


@dataclass(frozen=True)
class Term(Node):
    """A value of a field; None is the default field."""

    field: str | None
    text: str


@dataclass(frozen=True)
class Match(Node):
    """Raw text analysed as a whole, without query syntax."""

    field: str
    text: str


@dataclass(frozen=True)
class Pattern(Node):
    """A whole value or token that a regular expression describes; prefix is set where that is all it asks for."""

    field: str | None
    expression: str
    prefix: str | None = None
    plain: str = ""


@dataclass(frozen=True)
class Fuzzy(Node):
    field: str | None
    text: str
    edits: int


@dataclass(frozen=True)
class Range(Node):
    """Bounds as text, None for an open end."""

    field: str | None
    low: str | None
    high: str | None
    with_low: bool = True
    with_high: bool = True


@dataclass(frozen=True)
class Boolean(Node):
    clauses: tuple[tuple[str, Node], ...]


@dataclass(frozen=True)
class Boost(Node):
    node: Node
    factor: float


@dataclass(frozen=True)
class Nearest(Node):
    """The k vectors most like the query among the rows that pass the filter."""

    field: str
    vector: tuple[float, ...]
    k: int
    filter: Node | None = None
