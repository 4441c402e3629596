"""Graph schemas: which tables hold which labels and relationship types."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from graphloom.plans.ast import CypherError


def as_list(x: Any) -> tuple:
    return () if x is None else tuple(x) if isinstance(x, list | tuple) else (x,)


@dataclass(frozen=True)
class NodeDef:
    label: str
    table: str
    id: tuple
    props: dict = field(default_factory=dict, hash=False)
    from_props: dict = field(default_factory=dict, hash=False)
    to_props: dict = field(default_factory=dict, hash=False)
    filter: str | None = None
    label_column: str | None = None
    label_value: Any = None
    source: str | None = None
    types: dict = field(default_factory=dict, hash=False)
    view_parameters: tuple = ()
    discover: bool = False
    exclude: tuple = ()
    naming: str = "snake_case"
    id_generation: str = "provided"

    @property
    def embedded(self) -> bool:
        """Properties live in edge tables; the node has no table of its own."""
        return bool(self.from_props or self.to_props) and not self.props

    @property
    def property_names(self) -> list[str]:
        return sorted({*self.props, *self.from_props, *self.to_props})


@dataclass(frozen=True)
class EdgeDef:
    type: str
    table: str
    from_id: tuple
    to_id: tuple
    from_label: str | None
    to_label: str | None
    props: dict = field(default_factory=dict, hash=False)
    edge_id: tuple = ()
    filter: str | None = None
    constraints: str | None = None
    source: str | None = None
    types: dict = field(default_factory=dict, hash=False)
    view_parameters: tuple = ()
    type_column: str | None = None
    from_label_column: str | None = None
    to_label_column: str | None = None
    discover: bool = False
    exclude: tuple = ()
    naming: str = "snake_case"


@dataclass(frozen=True)
class VectorIndex:
    name: str
    label: str
    property: str
    dimensions: int | None = None
    similarity: str = "cosine"


@dataclass(frozen=True)
class FulltextIndex:
    name: str
    label: str
    properties: tuple
    analyzer: str = "standard"


@dataclass(frozen=True)
class GraphSchema:
    name: str
    nodes: dict = field(hash=False)
    edges: tuple = ()
    vector_indexes: tuple = ()
    fulltext_indexes: tuple = ()

    def node(self, label: str) -> NodeDef:
        if label not in self.nodes:
            raise CypherError(f"unknown label {label!r} in schema {self.name!r}")
        return self.nodes[label]

    def edges_of(self, types: tuple) -> list[EdgeDef]:
        have = {e.type for e in self.edges}
        for t in types:
            if t not in have:
                raise CypherError(f"unknown relationship type {t!r} in schema {self.name!r}")
        return [e for e in self.edges if not types or e.type in types]

    @property
    def types(self) -> list[str]:
        return sorted({e.type for e in self.edges})


def node_of(d: dict) -> NodeDef:
    ids = as_list(d.get("node_id") or d.get("id") or d.get("id_column"))
    if not ids:
        raise CypherError(f"node {d.get('label')!r} has no node_id")
    return NodeDef(
        d["label"], d.get("table") or d.get("source") or d["label"], ids, dict(d.get("property_mappings") or d.get("properties") or {}), dict(d.get("from_node_properties") or {}), dict(d.get("to_node_properties") or {}),
        d.get("filter"), d.get("label_column"), d.get("label_value"), d.get("source"), dict(d.get("property_types") or {}), as_list(d.get("view_parameters")), bool(d.get("auto_discover_columns")), as_list(d.get("exclude_columns")), d.get("naming_convention") or "snake_case", d.get("id_generation") or "provided",
    )


def edges_from(d: dict) -> list[EdgeDef]:
    def one(kind: str) -> EdgeDef:
        return EdgeDef(
            kind, d.get("table") or d.get("source") or kind, as_list(d.get("from_id") or d.get("from_column")), as_list(d.get("to_id") or d.get("to_column")), d.get("from_node"), d.get("to_node"), dict(d.get("property_mappings") or d.get("properties") or {}),
            as_list(d.get("edge_id")), d.get("filter"), d.get("constraints"), d.get("source"), dict(d.get("property_types") or {}), as_list(d.get("view_parameters")), d.get("type_column"), d.get("from_label_column"), d.get("to_label_column"), bool(d.get("auto_discover_columns")), as_list(d.get("exclude_columns")), d.get("naming_convention") or "snake_case",
        )

    kinds = as_list(d.get("type_values")) if d.get("polymorphic") or d.get("type_values") else (d.get("type") or d.get("name"),)
    out = []
    for kind in kinds:
        e = one(kind)
        froms = as_list(d.get("from_label_values")) if e.from_label is None else ()
        tos = as_list(d.get("to_label_values")) if e.to_label is None else ()
        for f in froms or (e.from_label,):
            for t in tos or (e.to_label,):
                out.append(replace(e, from_label=f, to_label=t))
    return out


def schema_of(d: dict, name: str | None = None) -> GraphSchema:
    body = d.get("graph_schema", d)
    nodes = {}
    for n in body.get("nodes") or ():
        one = node_of(n)
        if one.label in nodes:
            raise CypherError(f"label {one.label!r} is defined twice")
        nodes[one.label] = one
    edges = [e for x in (body.get("edges") or body.get("relationships") or ()) for e in edges_from(x)]
    for e in edges:
        for end in (e.from_label, e.to_label):
            if end is not None and end not in nodes:
                raise CypherError(f"relationship {e.type!r} refers to unknown label {end!r}")
    vectors = tuple(VectorIndex(v["name"], v["label"], v["property"], v.get("dimensions"), v.get("similarity") or "cosine") for v in body.get("vector_indexes") or ())
    texts = tuple(FulltextIndex(v["name"], v["label"], as_list(v.get("properties") or v.get("property")), v.get("analyzer") or "standard") for v in body.get("fulltext_indexes") or ())
    return GraphSchema(name or d.get("name") or "default", nodes, tuple(edges), vectors, texts)


def load_schemas(source: str | dict) -> tuple[dict[str, GraphSchema], str]:
    """Schemas by name and the default one, of a dict, YAML text or a path."""
    if isinstance(source, str):
        try:
            import yaml
        except ImportError as e:  # pragma: no cover
            raise CypherError("YAML schemas need PyYAML; pass a dict") from e
        if "\n" not in source:
            with open(source, encoding="utf-8") as f:
                source = f.read()
        source = yaml.safe_load(source)
    if "schemas" in source:
        found = [schema_of(s) for s in source["schemas"]]
        return {s.name: s for s in found}, source.get("default_schema") or found[0].name
    one = schema_of(source)
    return {one.name: one}, one.name


def draft_schema(frames: dict, name: str = "draft") -> dict:
    """A schema draft from tables: single-column *_id / *key first columns are
    taken as ids, columns named like another table's id as foreign keys."""
    nodes, edges, owners = [], [], {}
    for table, df in frames.items():
        first = df.columns[0]
        nodes.append({"label": table.title().replace("_", ""), "table": table, "node_id": first, "property_mappings": {c: c for c in df.columns}})
        owners[first.split("_")[-1]] = (table, first)
    for table, df in frames.items():
        for c in df.columns[1:]:
            to = owners.get(c.split("_")[-1])
            if to and to[0] != table:
                edges.append({"type": f"{table}_{to[0]}".upper(), "table": table, "from_id": df.columns[0], "to_id": c, "from_node": table.title().replace("_", ""), "to_node": to[0].title().replace("_", "")})
    return {"name": name, "graph_schema": {"nodes": nodes, "edges": edges}}
