"""Syntax trees of the dialect."""

from __future__ import annotations

from dataclasses import dataclass, field


class SqlError(ValueError):
    """A statement outside the dialect, or one that does not fit the tables."""


class Node:
    """A part of a statement."""


@dataclass(frozen=True)
class Lit(Node):
    value: object  # None, bool, int, float or str
    kind: str = ""  # "time" for DATE '...' and TIMESTAMP '...'


@dataclass(frozen=True)
class Col(Node):
    name: str
    table: str | None = None


@dataclass(frozen=True)
class Var(Node):
    name: str  # @@name, without the signs and the scope


@dataclass(frozen=True)
class Star(Node):
    table: str | None = None


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple = ()
    distinct: bool = False


@dataclass(frozen=True)
class Cast(Node):
    value: Node
    kind: str


@dataclass(frozen=True)
class Bin(Node):
    op: str  # + - * / % = <> < <= > >= and or
    left: Node
    right: Node


@dataclass(frozen=True)
class Not(Node):
    value: Node


@dataclass(frozen=True)
class Neg(Node):
    value: Node


@dataclass(frozen=True)
class Case(Node):
    subject: Node | None
    whens: tuple
    otherwise: Node | None


@dataclass(frozen=True)
class Test(Node):
    """LIKE, REGEXP, BETWEEN, IN and IS NULL, not yet negated."""

    op: str
    value: Node
    args: tuple


@dataclass(frozen=True)
class Row(Node):
    items: tuple


@dataclass(frozen=True)
class Match(Node):
    column: Node
    query: str


@dataclass(frozen=True)
class Sub(Node):
    query: Query


@dataclass(frozen=True)
class Exists(Node):
    query: Query


@dataclass(frozen=True)
class Default(Node):
    """DEFAULT in a list of values."""


# -- sources and queries -----------------------------------------------------------------------


@dataclass(frozen=True)
class Table(Node):
    name: str
    alias: str


@dataclass(frozen=True)
class Derived(Node):
    query: Query
    alias: str


@dataclass(frozen=True)
class Join(Node):
    how: str
    left: Node
    right: Node
    on: Node | None = None
    using: tuple = ()


@dataclass(frozen=True)
class Key(Node):
    """An ORDER BY key."""

    value: Node
    descending: bool = False
    nulls: str | None = None


@dataclass(frozen=True)
class Item(Node):
    value: Node
    alias: str


@dataclass(frozen=True)
class Select(Node):
    items: tuple
    source: Node | None = None
    where: Node | None = None
    group: tuple = ()
    having: Node | None = None
    distinct: bool = False


@dataclass(frozen=True)
class Query(Node):
    """One SELECT or several under UNION ALL, with what applies to the whole."""

    branches: tuple
    order: tuple = ()
    limit: int | None = None
    offset: int = 0


@dataclass(frozen=True)
class Statement(Node):
    """Anything that is not a query: its kind, and what it holds by name."""

    kind: str
    parts: dict = field(default_factory=dict)

    def __getattr__(self, name):
        try:
            return self.parts[name]
        except KeyError:
            raise AttributeError(name) from None
