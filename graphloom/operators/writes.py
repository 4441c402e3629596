"""CREATE, SET, REMOVE and DELETE as new versions of table frames.

A write replaces the frame of a table that was given to the graph; tables read
from a source, foreign-key relationships and virtual nodes can't be written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans import ast as A
from graphloom.plans.ast import CypherError
from graphloom.plans.compiler import Compiler, Frame
from graphloom.plans.scope import Node, col
from graphloom.sources.frames import key
from graphloom.sources.storage import stored

WRITES = (A.Create, A.SetItems, A.Remove, A.Delete)


def is_write(q) -> bool:
    return isinstance(q, A.Query) and any(isinstance(c, WRITES) for p in q.parts for c in p)


def writable(graph, d) -> DataFrame:
    found = graph.tables.given.get(d.table)
    if d.source or found is None or not isinstance(found, DataFrame):
        raise CypherError(f"table {d.table!r} can't be written")
    if getattr(d, "embedded", False):
        raise CypherError(f"{d.label!r} has no table of its own")
    return found


def plain_column(d, prop: str) -> str:
    c = d.props.get(prop, prop if prop in d.id else None)
    if c is None or not str(c).replace("_", "").isalnum():
        raise CypherError(f"property {prop!r} of {d.label!r} can't be written")
    return c


def run_write(graph, schema, q: A.Query, params: dict) -> DataFrame:
    counters = {"nodes_created": 0, "properties_set": 0, "nodes_deleted": 0, "relationships_deleted": 0}
    result = None
    for part in q.parts:
        comp = Compiler(graph, schema, params, graph.max_hops)
        comp.note_uses(part)
        comp.star = True
        frame = Frame(None, {})
        for c in part:
            if isinstance(c, A.Match):
                frame = comp.optional(frame, c) if c.optional else comp.match(frame, c)
            elif isinstance(c, A.Unwind):
                frame = comp.unwind(frame, c)
            elif isinstance(c, A.Project):
                frame = comp.project(frame, c)
                if c.kind == "RETURN":
                    result = comp.output(frame, c)
            elif isinstance(c, A.Create):
                frame = create(graph, schema, comp, frame, c, counters)
            elif isinstance(c, A.SetItems):
                update(graph, schema, comp, frame, c.items, counters)
            elif isinstance(c, A.Remove):
                update(graph, schema, comp, frame, tuple((v, k, A.Lit(None)) for v, k in c.items), counters)
            elif isinstance(c, A.Delete):
                delete(graph, schema, frame, c, counters)
            else:
                raise CypherError(f"{type(c).__name__} can't be part of a write")
    graph.counters = dict(counters)
    return result if result is not None else graph.spark.createDataFrame([tuple(counters.values())], ", ".join(f"{k} long" for k in counters))


def create(graph, schema, comp: Compiler, frame: Frame, c: A.Create, counters: dict) -> Frame:
    frame = comp.started(frame)
    frame = Frame(stored(frame.df, "rows"), frame.scope)
    for p in c.patterns:
        if len(p.items) > 1:
            raise CypherError("CREATE of relationships is not supported; use create_edges")
        n = p.items[0]
        if len(n.labels) != 1:
            raise CypherError("CREATE needs exactly one label")
        d = schema.node(n.labels[0])
        old = writable(graph, d)
        e = comp.expr(frame)
        values = {plain_column(d, k): e(v) for k, v in (comp.prop_items(n.props) if n.props is not None else ())}
        for i in d.id:
            if i not in values:
                if d.id_generation == "uuid":
                    values[i] = F.uuid()
                elif d.id_generation == "snowflake":
                    values[i] = F.lit(uuid.uuid1().time << 10) + F.monotonically_increasing_id()
                else:
                    raise CypherError(f"CREATE of {d.label!r} needs {i!r}")
        if d.label_column:
            values[d.label_column] = F.lit(d.label_value)
        fresh = frame.df.select(*((values[x.name] if x.name in values else F.lit(None)).cast(x.dataType).alias(x.name) for x in old.schema))
        fresh = stored(fresh, "created")
        counters["nodes_created"] += (n_rows := fresh.count())
        counters["properties_set"] += n_rows * len(values)
        graph.tables.given[d.table] = old.unionByName(fresh)
    return frame


def own_key(old: DataFrame, d):
    """The id of the rows that are nodes of this label; null for those of other
    labels of the same table."""
    own = key(old, d.id)
    if d.label_column:
        own = F.when(F.col(d.label_column) == F.lit(d.label_value), own)
    return F.when(F.expr(d.filter), own) if d.filter else own


def end_key(old: DataFrame, e, label: str, side: str):
    """The id of an edge table's rows whose end at this side is a node of the
    label, as a column says if there is one."""
    column, ids = (e.from_label_column, e.from_id) if side == "from" else (e.to_label_column, e.to_id)
    own = key(old, ids)
    if column:
        own = F.when(F.col(column) == F.lit(label), own)
    if e.type_column:
        own = F.when(F.col(e.type_column) == F.lit(e.type), own)
    return F.when(F.expr(e.filter), own) if e.filter else own


def matched_ids(frame: Frame, var: str) -> tuple[DataFrame, Node]:
    b = frame.scope.get(var)
    if not isinstance(b, Node):
        raise CypherError(f"{var!r} is not a node")
    if len(b.labels) != 1:
        raise CypherError(f"{var!r} needs exactly one label to be written")
    return frame.df.where(col(b.id).isNotNull()), b


def update(graph, schema, comp: Compiler, frame: Frame, items: tuple, counters: dict) -> None:
    frame = Frame(stored(frame.df, "rows"), frame.scope)
    for var, prop, value in items:
        rows, b = matched_ids(frame, var)
        d = schema.node(b.labels[0])
        old = writable(graph, d)
        target = plain_column(d, prop)
        if target in d.id:
            raise CypherError("an id can't be set")
        new = rows.select(col(b.id).alias("__id"), comp.expr(frame)(value).cast(old.schema[target].dataType).alias("__new")).groupBy("__id").agg(F.max("__new").alias("__new"), F.lit(True).alias("__hit"))  # of several values the greatest
        both = old.withColumn("__id", own_key(old, d)).join(new, "__id", "left")
        counters["properties_set"] += new.count()
        out = both.withColumn(target, F.when(F.col("__hit"), F.col("__new")).otherwise(F.col(target))).select(*old.columns)
        graph.tables.given[d.table] = stored(out, d.table)


def delete(graph, schema, frame: Frame, c: A.Delete, counters: dict) -> None:
    frame = Frame(stored(frame.df, "rows"), frame.scope)
    for var in c.vars:
        rows, b = matched_ids(frame, var)
        ids = stored(rows.select(col(b.id).alias("__id")).distinct(), "ids")
        label = b.labels[0]
        d = schema.node(label)
        for e in schema.edges:
            for side in ("from", "to"):
                said = e.from_label if side == "from" else e.to_label
                if e.table == d.table or said not in (None, label):
                    continue
                node_tables = {n.table for n in schema.nodes.values()}
                old = writable(graph, e) if c.detach else graph.tables.read(e.table, e.source, e.view_parameters)
                keyed = old.withColumn("__id", end_key(old, e, label, side))
                hit = keyed.join(ids, "__id", "left_semi").count()
                if hit and not c.detach:
                    raise CypherError(f"{var!r} still has relationships; use DETACH DELETE")
                if hit and e.table in node_tables:
                    raise CypherError(f"relationship {e.type!r} is a foreign key and can't be deleted")
                if hit:
                    counters["relationships_deleted"] += hit
                    graph.tables.given[e.table] = stored(keyed.join(ids, "__id", "left_anti").select(*old.columns), e.table)
        old = writable(graph, d)
        keyed = old.withColumn("__id", own_key(old, d))
        counters["nodes_deleted"] += keyed.join(ids, "__id", "left_semi").count()
        graph.tables.given[d.table] = stored(keyed.join(ids, "__id", "left_anti").select(*old.columns), d.table)
