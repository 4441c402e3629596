"""CALL procedures: catalog lists, statistics, search, ranking, exports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.aggregate import AGGREGATES
from graphloom.functions.scalar import TABLE
from graphloom.operators import paths, search
from graphloom.plans.ast import CypherError
from graphloom.sources.frames import edge_frame, mapping, node_frame


def rows(spark, data: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(data, schema)


def type_name(df: DataFrame, name: str) -> str:
    kind = df.schema[name].dataType.simpleString()
    return {"bigint": "Long", "int": "Long", "smallint": "Long", "double": "Double", "float": "Double", "string": "String", "boolean": "Boolean", "date": "Date", "timestamp": "DateTime"}.get(kind, "List" if kind.startswith("array") else "String")


def node_types(graph, schema, args):
    out = []
    for label in sorted(schema.nodes):
        df = node_frame(graph.tables, schema, label)
        for p in (c for c in df.columns if not c.startswith("__")):
            out.append((f":`{label}`", [label], p, [type_name(df, p)], False))
    return rows(graph.spark, out, "nodeType string, nodeLabels array<string>, propertyName string, propertyTypes array<string>, mandatory boolean")


def rel_types(graph, schema, args):
    out = {}
    for d in schema.edges:
        ef = edge_frame(graph.tables, schema, d)
        for p in ef.props:
            out[d.type, p] = (f":`{d.type}`", p, [type_name(ef.df, p)], False)
    return rows(graph.spark, [out[k] for k in sorted(out)], "relType string, propertyName string, propertyTypes array<string>, mandatory boolean")


def property_keys(graph, schema, args):
    keys = {p for d in schema.nodes.values() for p in d.property_names} | {p for d in schema.edges for p in d.props}
    return rows(graph.spark, [(k,) for k in sorted(keys)], "propertyKey string")


def schema_map(graph, schema) -> dict:
    out = {}
    for label, d in sorted(schema.nodes.items()):
        df = node_frame(graph.tables, schema, label)
        rels = {}
        for e in schema.edges:
            if e.from_label == label:
                rels[e.type] = {"direction": "out", "labels": [e.to_label], "type": "relationship"}
            elif e.to_label == label:
                rels.setdefault(e.type, {"direction": "in", "labels": [e.from_label], "type": "relationship"})
        out[label] = {"type": "node", "properties": {p: {"type": type_name(df, p).upper(), "indexed": False, "unique": p in d.id} for p in df.columns if not p.startswith("__")}, "relationships": rels}
    for e in schema.edges:
        out[e.type] = {"type": "relationship", "properties": {p: {"type": "STRING"} for p in sorted(e.props)}, "relationships": {}}
    return out


def stats(graph, schema, args):
    labels = {x: node_frame(graph.tables, schema, x).count() for x in sorted(schema.nodes)}
    types: dict[str, int] = {}
    for d in schema.edges:
        types[d.type] = types.get(d.type, 0) + edge_frame(graph.tables, schema, d).df.count()
    return rows(graph.spark, [(len(labels), len(types), sum(labels.values()), sum(types.values()), json.dumps(labels), json.dumps(types))], "labelCount long, relTypeCount long, nodeCount long, relCount long, labels string, relTypes string")


def page_rank(graph, schema, args):
    from graphloom.plans.compiler import unite

    named = {k: v for k, v in args if k}
    labels = named.get("nodeLabels")
    types = named.get("relationshipTypes")
    split = lambda x: [i.strip() for i in x.split(",")] if isinstance(x, str) else list(x) if x else None
    types, labels = split(types), split(labels)
    defs = schema.edges_of(tuple(types or ()))
    if labels is None:
        labels = sorted({x for d in defs for x in (d.from_label, d.to_label) if x}) or sorted(schema.nodes)
    iterations, damping = int(named.get("maxIterations", named.get("iterations", 10))), float(named.get("dampingFactor", 0.85))
    if iterations < 1 or not 0 <= damping <= 1:
        raise CypherError("pagerank: maxIterations must be positive and dampingFactor between 0 and 1")
    ids = ("__id", "__src", "__dst")
    edges = []
    for d in defs:
        df = edge_frame(graph.tables, schema, d).df.select("__src", "__src_label", "__dst", "__dst_label")
        for end in ("__src_label", "__dst_label"):
            if len(labels) == 1:  # an end that no label is given for
                df = df.withColumn(end, F.coalesce(end, F.lit(labels[0])))
        edges.append(df.where(F.col("__src_label").isin(labels) & F.col("__dst_label").isin(labels)))
    if not edges:
        raise CypherError("pagerank: no relationships")
    nodes = [node_frame(graph.tables, schema, x).select("__id", "__label") for x in labels]
    # ids of different kinds as text, alike in nodes and edges
    kinds = {f.schema[c].dataType.simpleString() for f in [*nodes, *edges] for c in ids if c in f.columns}
    if len(kinds) > 1:
        kind = "bigint" if kinds <= {"int", "bigint", "smallint", "tinyint"} else "string"
        cast = lambda f: f.select(*(F.col(c).cast(kind).alias(c) if c in ids else c for c in f.columns))
        nodes, edges = [cast(f) for f in nodes], [cast(f) for f in edges]
    out = paths.pagerank(unite(nodes, ()), unite(edges, ()), iterations, damping)
    return out if len(labels) > 1 else out.drop("label")


def exported(fmt: str):
    def run(graph, schema, args):
        values = [v for _, v in args]
        if len(values) < 2:
            raise CypherError(f"apoc.export.{fmt}.query needs a query and a destination")
        options = dict(values[2]) if len(values) > 2 and values[2] else {}
        df = graph.cypher(values[0], options.pop("params", None), schema=schema.name)
        from graphloom.sources.storage import write_export

        write_export(df, values[1], {"json": "jsoneachrow", "csv": "csvwithnames"}.get(fmt, fmt), options)
        return rows(graph.spark, [(values[1], fmt, len(df.columns))], "file string, format string, columns long")

    return run


def set_value(graph, schema, args):
    values = [v for _, v in args]
    graph.session[str(values[0])] = values[1]
    if str(values[0]) in ("tenant", "tenant_id"):
        graph.tables.params["tenant_id"] = values[1]
    return rows(graph.spark, [(str(values[0]), str(values[1]))], "name string, value string")


def fixed(schema_text: str, *data: tuple):
    return lambda graph, schema, args: rows(graph.spark, list(data), schema_text)


def listing(names, schema_text):
    return lambda graph, schema, args: rows(graph.spark, [(n, "") for n in sorted(names())], schema_text)


USER = fixed("username string, roles array<string>, flags array<string>", ("spark", ["admin"], []))
PROCEDURES = {
    "db.labels": lambda g, s, a: rows(g.spark, [(x,) for x in sorted(s.nodes)], "label string"),
    "db.relationshiptypes": lambda g, s, a: rows(g.spark, [(x,) for x in s.types], "relationshipType string"),
    "db.propertykeys": property_keys,
    "db.schema.nodetypeproperties": node_types,
    "db.schema.reltypeproperties": rel_types,
    "db.schema.visualization": lambda g, s, a: rows(g.spark, [(sorted(s.nodes), [f"{d.from_label}-{d.type}->{d.to_label}" for d in s.edges])], "nodes array<string>, relationships array<string>"),
    "db.indexes": lambda g, s, a: rows(g.spark, [(i.name, "VECTOR", [i.label], [i.property]) for i in s.vector_indexes] + [(i.name, "FULLTEXT", [i.label], list(i.properties)) for i in s.fulltext_indexes], "name string, type string, labelsOrTypes array<string>, properties array<string>"),
    "apoc.meta.schema": lambda g, s, a: rows(g.spark, [(k, json.dumps(v)) for k, v in sorted(schema_map(g, s).items())], "key string, value string"),
    "apoc.meta.stats": stats,
    "dbms.components": fixed("name string, versions array<string>, edition string", ("graphloom", ["1.0"], "community")),
    "dbms.info": fixed("id string, name string, creationDate string", ("graphloom", "graphloom", "")),
    "dbms.procedures": listing(lambda: PROCEDURES, "name string, description string"),
    "dbms.functions": listing(lambda: [*TABLE, *AGGREGATES], "name string, description string"),
    "dbms.clientconfig": fixed("key string, value string", ("browser.retain_connection_credentials", "true")),
    "dbms.showcurrentuser": USER,
    "dbms.security.showcurrentuser": USER,
    "dbms.licenseagreementdetails": fixed("status string, daysLeftOnTrial long", ("yes", 0)),
    "pagerank": page_rank,
    "gds.pagerank": page_rank,
    "apoc.export.csv.query": exported("csv"),
    "apoc.export.json.query": exported("json"),
    "apoc.export.parquet.query": exported("parquet"),
    "sys.set": set_value,
    "dbms.setconfigvalue": set_value,
}
SEARCHES = {"db.index.vector.querynodes": search.vector_query, "db.index.fulltext.querynodes": search.fulltext_query}


def call_procedure(graph, schema, name: str, args: list):
    """(frame, node binding or None)."""
    low = name.lower()
    if low in SEARCHES:
        return SEARCHES[low](graph, schema, [v for _, v in args])
    if low not in PROCEDURES:
        raise CypherError(f"unknown procedure {name!r}")
    return PROCEDURES[low](graph, schema, args), None


def show(graph, what: str) -> DataFrame:
    if what.startswith("DATABASES") or what.startswith("DATABASE"):
        return rows(graph.spark, [(n, "online", n == graph.default) for n in sorted(graph.schemas)], "name string, currentStatus string, default boolean")
    if what.startswith("PROCEDURES"):
        return PROCEDURES["dbms.procedures"](graph, None, [])
    if what.startswith("FUNCTIONS"):
        return PROCEDURES["dbms.functions"](graph, None, [])
    if what.startswith("INDEXES"):
        return PROCEDURES["db.indexes"](graph, graph.schemas[graph.default], [])
    if what.startswith("CURRENT USER") or what.startswith("USERS"):
        return USER(graph, None, [])
    return rows(graph.spark, [], "name string")


__all__ = ["call_procedure", "mapping", "show", "F"]
