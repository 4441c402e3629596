"""Every label as a node frame, every relationship type as an edge frame.

A node frame has __id, __label and the properties; an edge frame __src, __dst,
__eid, __type, __src_label, __dst_label and the properties.  Standard tables,
foreign keys, shared and polymorphic tables and denormalised layouts are only
different builders of these frames; Catalyst prunes what a query does not use.
Where an endpoint's properties stand in the edge's own row, the edge frame
brings them along (embedded), so that no join is needed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.ast import CypherError
from graphloom.sources.schema import EdgeDef, GraphSchema, NodeDef
from graphloom.sources.storage import read_source

#: Declared property types as Spark types.
TYPES = {"integer": "bigint", "int": "bigint", "long": "bigint", "float": "double", "double": "double", "decimal": "double", "string": "string", "text": "string", "boolean": "boolean", "bool": "boolean", "datetime": "timestamp", "timestamp": "timestamp", "date": "date", "uuid": "string"}


def column(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`") if name in df.columns else F.expr(name)


def key(df: DataFrame, names: tuple) -> Column:
    cols = [column(df, n) for n in names]
    return cols[0] if len(cols) == 1 else F.struct(*(c.alias(f"k{i}") for i, c in enumerate(cols)))


def key_filled(df: DataFrame, names: tuple) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & column(df, n).isNotNull()
    return out


def to_camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.title() for x in rest)


@dataclass
class Tables:
    """Where table names lead to: frames given, else a source, else Spark's
    catalog.  view(name) may also be a function of the view parameters."""

    spark: SparkSession
    given: dict = field(default_factory=dict)
    params: dict = field(default_factory=dict)

    def read(self, table: str, source: str | None = None, parameters: tuple = ()) -> DataFrame:
        found = self.given.get(table)
        if found is None:
            found = read_source(self.spark, source) if source else self.spark.table(table)
        if callable(found) and not isinstance(found, DataFrame):
            missing = [p for p in parameters if p not in self.params]
            if missing:
                raise CypherError(f"view {table!r} needs parameters {missing}")
            found = found(**{p: self.params[p] for p in parameters})
        elif parameters:
            for p in parameters:
                if p not in self.params:
                    raise CypherError(f"view {table!r} needs parameter {p!r}")
                found = found.where(F.col(p) == F.lit(self.params[p]))
        return found


def mapping(df: DataFrame, d: NodeDef | EdgeDef) -> dict:
    props = dict(d.props)
    if d.discover:
        for c in df.columns:
            if c not in d.exclude and c not in props.values():
                props.setdefault(to_camel(c) if d.naming.lower().startswith("camel") else c, c)
    return props


def prop_columns(df: DataFrame, props: dict, types: dict) -> list[Column]:
    out = []
    for name, source in sorted(props.items()):
        c = column(df, str(source))
        if str(types.get(name, "")).lower() in TYPES:
            c = c.cast(TYPES[str(types[name]).lower()])
        out.append(c.alias(name))
    return out


def only(props: dict, keep: set | None) -> dict:
    return props if keep is None else {k: v for k, v in props.items() if k in keep}


def node_frame(tables: Tables, schema: GraphSchema, label: str, keep: set | None = None) -> DataFrame:
    """__id, __label and one column a property, or for those in keep."""
    d = schema.node(label)
    if d.embedded:
        return embedded_nodes(tables, schema, d)
    df = tables.read(d.table, d.source, d.view_parameters)
    if d.label_column:
        df = df.where(column(df, d.label_column) == F.lit(d.label_value))
    if d.filter:
        df = df.where(F.expr(d.filter))
    return df.select(key(df, d.id).alias("__id"), F.lit(label).alias("__label"), *prop_columns(df, only(mapping(df, d), keep), d.types))


def embedded_nodes(tables: Tables, schema: GraphSchema, d: NodeDef) -> DataFrame:
    """The distinct nodes of both sides of a denormalised table."""
    df = tables.read(d.table, d.source, d.view_parameters)
    if d.filter:
        df = df.where(F.expr(d.filter))
    sides = []
    for props in (d.from_props, d.to_props):
        if not props:
            continue
        names = {n: props.get(n) for n in d.property_names}
        id_columns = tuple(str(props.get(i, i)) for i in d.id)
        cols = [(column(df, str(c)) if c else F.lit(None).cast("string")).alias(n) for n, c in names.items()]
        sides.append(df.where(key_filled(df, id_columns)).select(key(df, id_columns).alias("__id"), F.lit(d.label).alias("__label"), *cols))
    out = sides[0]
    for s in sides[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out.groupBy("__id", "__label").agg(*(F.min(n).alias(n) for n in d.property_names))


@dataclass
class EdgeFrame:
    df: DataFrame
    props: list
    #: property -> column, for an endpoint that the edge's row describes whole
    src_props: dict | None = None
    dst_props: dict | None = None


def endpoint(df: DataFrame, d: EdgeDef, node: NodeDef | None, ids: tuple, side: str, same_table: bool, keep: set | None):
    """Columns of an endpoint's properties (those in keep), if the edge's row
    has them all."""
    if node is None:
        return None
    embedded = node.from_props if side == "src" else node.to_props
    if node.embedded:
        return {n: column(df, str(c)) for n, c in only(embedded, keep).items()} if same_table and embedded else None
    if same_table and tuple(ids) == tuple(node.id) and not node.label_column:
        return dict(zip(sorted(m := only(mapping(df, node), keep)), prop_columns(df, m, node.types), strict=True))
    return None


def edge_frame(tables: Tables, schema: GraphSchema, d: EdgeDef, keep: set | None = None, keep_src: set | None = None, keep_dst: set | None = None) -> EdgeFrame:
    """The edges, with all properties or those in keep; likewise of the ends."""
    if d.constraints:
        keep_src = keep_dst = None
    df = tables.read(d.table, d.source, d.view_parameters)
    if d.type_column:
        df = df.where(column(df, d.type_column) == F.lit(d.type))
    for label, col in ((d.from_label, d.from_label_column), (d.to_label, d.to_label_column)):
        if col and label:
            df = df.where(column(df, col) == F.lit(label))
    if d.filter:
        df = df.where(F.expr(d.filter))
    df = df.where(key_filled(df, d.from_id) & key_filled(df, d.to_id))
    ends = {"src": (d.from_label, d.from_id), "dst": (d.to_label, d.to_id)}
    held, extra = {}, []
    for side, (label, ids) in ends.items():
        node = schema.nodes.get(label) if label else None
        own = endpoint(df, d, node, ids, side, node is not None and node.table == d.table, keep_src if side == "src" else keep_dst)
        if own is not None and node.filter:
            df = df.where(F.expr(node.filter))
        held[side] = None if own is None else {n: f"__{side}__{n}" for n in own}
        extra += [c.alias(f"__{side}__{n}") for n, c in (own or {}).items()]
    props = only(mapping(df, d), keep)
    eid = key(df, d.edge_id) if d.edge_id else F.struct(key(df, d.from_id).alias("k0"), key(df, d.to_id).alias("k1"))
    label_of = lambda label, col: F.lit(label) if label else column(df, col) if col else F.lit(None).cast("string")
    out = df.select(
        key(df, d.from_id).alias("__src"), key(df, d.to_id).alias("__dst"), eid.alias("__eid"), F.lit(d.type).alias("__type"),
        label_of(d.from_label, d.from_label_column).alias("__src_label"), label_of(d.to_label, d.to_label_column).alias("__dst_label"), *prop_columns(df, props, d.types), *extra,
    )
    if d.constraints:
        out = constrained(tables, schema, d, out, held)
    return EdgeFrame(out, sorted(props), held["src"], held["dst"])


def constrained(tables: Tables, schema: GraphSchema, d: EdgeDef, df: DataFrame, held: dict) -> DataFrame:
    """Edges for which a predicate over both endpoints holds, such as
    from.timestamp <= to.timestamp."""
    text = re.sub(r"\bfrom\.(\w+)", r"`__c_from`.`\1`", d.constraints)
    text = re.sub(r"\bto\.(\w+)", r"`__c_to`.`\1`", text)
    for side, label, name in (("src", d.from_label, "__c_from"), ("dst", d.to_label, "__c_to")):
        used = set(re.findall(rf"\b{name[4:]}\.(\w+)", d.constraints))
        if held[side]:
            df = df.withColumn(name, F.struct(*(F.col(held[side][p]).alias(p) for p in sorted(used))))
        elif used:
            n = node_frame(tables, schema, label)
            df = df.join(n.select(F.col("__id").alias(f"__{side}"), F.struct(*(F.col(p) for p in sorted(used))).alias(name)), f"__{side}")
    return df.where(F.expr(text)).drop("__c_from", "__c_to")
