"""What a name means while a query is compiled: columns of the row frame."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """A node variable: its columns in the row frame."""

    id: str
    label: str
    labels: tuple
    props: dict = field(hash=False)

    @property
    def columns(self) -> list[str]:
        return [self.id, self.label, *self.props.values()]


@dataclass(frozen=True)
class Edge:
    eid: str
    type: str
    src: str
    dst: str
    src_label: str
    dst_label: str
    types: tuple
    props: dict = field(hash=False)

    @property
    def columns(self) -> list[str]:
        return [self.eid, self.type, self.src, self.dst, self.src_label, self.dst_label, *self.props.values()]


@dataclass(frozen=True)
class Walk:
    """The relationships of a variable-length pattern: a list of structs."""

    rels: str

    @property
    def columns(self) -> list[str]:
        return [self.rels]


@dataclass(frozen=True)
class Path:
    """Lists of node and relationship structs, and an optional cost."""

    nodes: str
    rels: str
    cost: str | None = None

    @property
    def columns(self) -> list[str]:
        return [self.nodes, self.rels, *([self.cost] if self.cost else [])]


@dataclass(frozen=True)
class Value:
    name: str
    #: of a list or struct of nodes: their properties by struct field
    entity: tuple | None = None

    @property
    def columns(self) -> list[str]:
        return [self.name]


def col(name: str) -> Column:
    return F.col(f"`{name}`")
