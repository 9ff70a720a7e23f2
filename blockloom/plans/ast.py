"""The syntax tree of pipeline texts."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from blockloom.functions.types import Type


class Expr:
    """An expression."""


@dataclass(frozen=True)
class Text(Expr):
    """A string: literal parts and expressions in turn."""

    parts: tuple[str | Expr, ...]


@dataclass(frozen=True)
class Number(Expr):
    value: Decimal


@dataclass(frozen=True)
class DurationLit(Expr):
    ns: int


@dataclass(frozen=True)
class Bool(Expr):
    value: bool


@dataclass(frozen=True)
class Null(Expr):
    pass


@dataclass(frozen=True)
class ListLit(Expr):
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class MapLit(Expr):
    entries: tuple[tuple[str, Expr], ...]


@dataclass(frozen=True)
class Ref(Expr):
    """a.b.c, or a["k"].b with the keys of a matrix slice."""

    parts: tuple[str, ...]
    keys: tuple[Expr, ...] = ()

    def __str__(self) -> str:
        return ".".join(self.parts)


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class Pipe(Expr):
    """value | call: the value becomes the first argument."""

    value: Expr
    call: Call


@dataclass(frozen=True)
class If(Expr):
    test: Expr
    then: Expr
    other: Expr


@dataclass(frozen=True)
class Compare(Expr):
    left: Expr
    right: Expr
    equal: bool


@dataclass(frozen=True)
class Add(Expr):
    left: Expr
    right: Expr


@dataclass
class Import:
    url: str
    line: int = 0


@dataclass
class Let:
    name: str
    value: Expr
    type: Type | None = None
    doc: str = ""
    line: int = 0


@dataclass
class Param:
    name: str
    type: Type
    default: Expr | None = None
    doc: str = ""
    line: int = 0


@dataclass
class Target:
    name: str
    members: tuple[str, ...]
    doc: str = ""
    line: int = 0


@dataclass
class Output:
    name: str
    value: Expr
    doc: str = ""
    line: int = 0


@dataclass
class Block:
    name: str
    provider: str
    resource: str
    fields: dict[str, Expr] = field(default_factory=dict)
    phase: str = "default"
    protected: bool = False
    keys: tuple[str, ...] = ()
    doc: str = ""
    line: int = 0


Statement = Import | Let | Param | Target | Output | Block


@dataclass
class Module:
    statements: list[Statement]
    doc: str = ""

    def of(self, kind: type) -> list:
        return [s for s in self.statements if isinstance(s, kind)]


def children(e: Expr) -> list[Expr]:
    """The expressions directly inside."""
    if isinstance(e, Text):
        return [p for p in e.parts if isinstance(p, Expr)]
    if isinstance(e, ListLit):
        return list(e.items)
    if isinstance(e, MapLit):
        return [v for _, v in e.entries]
    if isinstance(e, Ref):
        return list(e.keys)
    if isinstance(e, Call):
        return list(e.args)
    if isinstance(e, Pipe):
        return [e.value, e.call]
    if isinstance(e, If):
        return [e.test, e.then, e.other]
    if isinstance(e, (Compare, Add)):
        return [e.left, e.right]
    return []


def references(e: Expr) -> list[Ref]:
    """All references in an expression, in order."""
    own = [e] if isinstance(e, Ref) else []
    return own + [r for c in children(e) for r in references(c)]
