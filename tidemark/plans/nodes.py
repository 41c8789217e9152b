"""Expressions and statements as plain data."""

from __future__ import annotations

from dataclasses import dataclass, field


class Node:
    """Any part of an expression."""


@dataclass(frozen=True)
class Literal(Node):
    value: object  # None stands for undefined


@dataclass(frozen=True)
class Ref(Node):
    name: str
    scope: str = ""  # "", MY or TARGET


@dataclass(frozen=True)
class Unary(Node):
    op: str
    arg: Node


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Choice(Node):
    """``condition ? then : other``; an undefined condition gives undefined."""

    condition: Node
    then: Node
    other: Node


@dataclass(frozen=True)
class Case(Node):
    """SQL's CASE; an undefined condition doesn't hold."""

    arms: tuple[tuple[Node, Node], ...]
    other: Node


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]


@dataclass(frozen=True)
class ListOf(Node):
    items: tuple[Node, ...]


@dataclass(frozen=True)
class Aggregate(Node):
    name: str  # COUNT SUM AVG MIN MAX
    column: str  # * for COUNT(*)
    distinct: bool = False
    where: Node | None = None


@dataclass(frozen=True)
class Bucket(Node):
    column: str
    width: int


@dataclass(frozen=True)
class Ranking(Node):
    name: str  # ROW_NUMBER RANK DENSE_RANK
    partition: tuple[str, ...]
    order: tuple[tuple[Node, bool], ...]  # descending


def children(node: Node) -> list[Node]:
    """Direct parts; those of an aggregate's FILTER and of a window are not among them."""
    match node:
        case Unary(_, a):
            return [a]
        case Binary(_, a, b):
            return [a, b]
        case Choice(a, b, c):
            return [a, b, c]
        case Case(arms, other):
            return [x for arm in arms for x in arm] + [other]
        case Call(_, items) | ListOf(items):
            return list(items)
    return []


def walk(node: Node):
    yield node
    for x in children(node):
        yield from walk(x)


def has(node: Node | None, kind: type) -> bool:
    return node is not None and any(isinstance(x, kind) for x in walk(node))


@dataclass(frozen=True)
class Item:
    node: Node
    text: str
    alias: str | None = None

    @property
    def header(self) -> str:
        return self.alias or self.text


@dataclass
class Select:
    table: str
    items: list[Item]  # empty for *
    distinct: bool = False
    as_of: str | None = None
    where: Node | None = None
    group: list[Node] = field(default_factory=list)
    having: Node | None = None
    qualify: Node | None = None
    order: list[tuple[Node, bool]] = field(default_factory=list)
    limit: int = 0

    @property
    def star(self) -> bool:
        return not self.items


@dataclass
class Insert:
    table: str
    values: dict[str, Node]
    texts: dict[str, str]


@dataclass
class Update:
    table: str
    values: dict[str, Node]
    texts: dict[str, str]
    where: Node | None = None


@dataclass
class Delete:
    table: str
    where: Node | None = None


@dataclass
class Create:
    kind: str  # TABLE, INDEX, VIEW
    name: str
    memory: bool = False
    columns: tuple[str, ...] = ()
    index: str = "VALUE"
    query: Select | None = None
    max_series: int = 0
    grace: int = 0
    retention: int = 0


@dataclass
class Drop:
    kind: str
    name: str
    columns: tuple[str, ...] = ()


@dataclass
class Match:
    requests: str
    resources: str
    key: str | None = None
    where: Node | None = None
    target: Node | None = None
    using: tuple[str, ...] = ()
    no_preempt: bool = False
    limit: int = 1


@dataclass
class Watch:
    query: Select
    since: str = "NOW"


@dataclass
class Transaction:
    action: str  # BEGIN COMMIT ROLLBACK


@dataclass
class Explain:
    query: Select
    analyze: bool = False
