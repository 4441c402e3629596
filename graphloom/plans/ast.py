"""Syntax tree of a query.  Nodes are frozen, so equal trees compare equal."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any


class CypherError(ValueError):
    """A query that can't be parsed, bound or compiled."""


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Param:
    name: str


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Prop:
    of: Any
    key: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple = ()
    distinct: bool = False


@dataclass(frozen=True)
class CountStar:
    pass


@dataclass(frozen=True)
class Op:
    """Unary and binary operators, by symbol."""

    op: str
    args: tuple


@dataclass(frozen=True)
class ListOf:
    items: tuple


@dataclass(frozen=True)
class MapOf:
    items: tuple  # (key, expression)


@dataclass(frozen=True)
class Index:
    of: Any
    at: Any


@dataclass(frozen=True)
class Slice:
    of: Any
    lo: Any
    hi: Any


@dataclass(frozen=True)
class Case:
    subject: Any
    whens: tuple  # (test, value)
    other: Any


@dataclass(frozen=True)
class ListComp:
    var: str
    of: Any
    where: Any
    value: Any


@dataclass(frozen=True)
class Quantifier:
    kind: str
    var: str
    of: Any
    where: Any


@dataclass(frozen=True)
class Reduce:
    acc: str
    init: Any
    var: str
    of: Any
    value: Any


@dataclass(frozen=True)
class Lambda:
    params: tuple
    body: Any


@dataclass(frozen=True)
class HasLabel:
    var: str
    labels: tuple


@dataclass(frozen=True)
class PatternExpr:
    """A pattern as an expression: kind is exists or count."""

    kind: str
    patterns: tuple
    where: Any = None


@dataclass(frozen=True)
class PatternComp:
    path: str | None
    pattern: Any
    where: Any
    value: Any


@dataclass(frozen=True)
class Col:
    """A column of the current frame (made while compiling)."""

    name: str


# ------------------------------------------------------------- patterns


@dataclass(frozen=True)
class NodePat:
    var: str | None
    labels: tuple
    props: Any  # MapOf, Param or None


@dataclass(frozen=True)
class RelPat:
    var: str | None
    types: tuple
    props: Any
    direction: str  # out, in, both
    hops: tuple | None  # (least, most or None)


@dataclass(frozen=True)
class PathPat:
    var: str | None
    items: tuple  # NodePat, RelPat, NodePat, ...
    kind: str = "plain"  # plain, shortest, all_shortest


# -------------------------------------------------------------- clauses


@dataclass(frozen=True)
class Match:
    patterns: tuple
    where: Any
    optional: bool


@dataclass(frozen=True)
class Unwind:
    of: Any
    var: str


@dataclass(frozen=True)
class Item:
    value: Any
    name: str
    aliased: bool


@dataclass(frozen=True)
class Project:
    """WITH and RETURN."""

    kind: str
    items: tuple
    star: bool
    distinct: bool
    order: tuple  # (expression, ascending)
    skip: Any
    limit: Any
    where: Any


@dataclass(frozen=True)
class CallProc:
    name: str
    args: tuple  # (name or None, expression)
    yields: tuple  # (column, alias)
    where: Any


@dataclass(frozen=True)
class Create:
    patterns: tuple


@dataclass(frozen=True)
class SetItems:
    items: tuple  # (variable, key, expression)


@dataclass(frozen=True)
class Remove:
    items: tuple  # (variable, key)


@dataclass(frozen=True)
class Delete:
    vars: tuple
    detach: bool


@dataclass(frozen=True)
class Query:
    schema: str | None
    parts: tuple  # of tuples of clauses
    unions: tuple  # "all" or "distinct" between the parts
    explain: bool = False


@dataclass(frozen=True)
class CopyTo:
    query: Query
    dest: str
    format: str | None
    options: tuple


@dataclass(frozen=True)
class Show:
    what: str


def children(x: Any):
    """The direct parts of a node, through tuples."""
    if isinstance(x, tuple):
        yield from x
    elif hasattr(x, "__dataclass_fields__"):
        for f in x.__dataclass_fields__:
            yield getattr(x, f)


def walk(x: Any):
    yield x
    for c in children(x):
        if isinstance(c, tuple) or hasattr(c, "__dataclass_fields__"):
            yield from walk(c)


def rebuild(x: Any, f):
    """x with f applied to every node from the top; f returns None to go on."""
    if isinstance(x, tuple):
        return tuple(rebuild(c, f) for c in x)
    if not hasattr(x, "__dataclass_fields__"):
        return x
    got = f(x)
    if got is not None:
        return got
    return type(x)(*(rebuild(getattr(x, k), f) for k in x.__dataclass_fields__))
