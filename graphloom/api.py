"""The library's entry: a graph over tables, queried in openCypher."""

from __future__ import annotations

import json
from collections import OrderedDict

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import procedures, writes
from graphloom.plans import ast as A
from graphloom.plans.ast import CypherError
from graphloom.plans.compiler import Compiler
from graphloom.plans.parser import parse
from graphloom.sources.frames import TYPES, Tables, edge_frame, node_frame
from graphloom.sources.schema import GraphSchema, draft_schema, load_schemas, schema_of
from graphloom.sources.storage import read_source, write_export


class Graph:
    """Graph(spark, schema, tables).cypher(text, params) -> DataFrame.

    schema: a dict, YAML text, a path, or a GraphSchema.  tables: frames (or
    functions of the view parameters) by table name; others are read from
    their source or Spark's catalog.

    trusted: every end of an edge is a row of its node table, and ids there are
    unique, so a node's table is joined only where its properties are used.
    With trusted=False it is always joined, one row an id, whatever a query
    returns.
    """

    def __init__(self, spark: SparkSession, schema, tables: dict | None = None, max_hops: int = 5, view_parameters: dict | None = None, trusted: bool = True) -> None:
        if isinstance(schema, GraphSchema):
            self.schemas, self.default = {schema.name: schema}, schema.name
        else:
            self.schemas, self.default = load_schemas(schema)
        self.spark, self.max_hops, self.trusted = spark, max_hops, trusted
        self.tables = Tables(spark, dict(tables or {}), dict(view_parameters or {}))
        self.session: dict = {}
        self.counters: dict = {}
        self.parsed: OrderedDict = OrderedDict()

    # ------------------------------------------------------------- queries

    def parse(self, text: str):
        if text not in self.parsed:
            self.parsed[text] = parse(text)
            if len(self.parsed) > 1000:
                self.parsed.popitem(last=False)
        return self.parsed[text]

    def schema(self, name: str | None = None) -> GraphSchema:
        name = name or self.default
        if name not in self.schemas:
            raise CypherError(f"unknown schema {name!r}")
        return self.schemas[name]

    def use(self, name: str) -> None:
        self.schema(name)
        self.default = name

    def add_schema(self, schema, name: str | None = None) -> None:
        if isinstance(schema, GraphSchema):
            found = {name or schema.name: schema}
        elif isinstance(schema, dict) and "schemas" not in schema:
            found = {name or schema.get("name", "default"): schema_of(schema, name)}
        else:
            found, _ = load_schemas(schema)
        self.schemas.update(found)

    def cypher(self, text: str, params: dict | None = None, schema: str | None = None) -> DataFrame:
        q = self.parse(text)
        params = checked(params or {})
        if isinstance(q, A.Show):
            return procedures.show(self, q.what)
        if isinstance(q, A.CopyTo):
            df = self.compiled(q.query, params, schema)
            write_export(df, q.dest, q.format, dict(q.options))
            return self.spark.createDataFrame([(q.dest, len(df.columns))], "file string, columns long")
        if q.explain:
            plan = self.compiled(q, params, schema)._jdf.queryExecution().toString()
            return self.spark.createDataFrame([(plan,)], "plan string")
        if writes.is_write(q):
            return writes.run_write(self, self.schema(q.schema or schema), q, params)
        return self.compiled(q, params, schema)

    query = cypher

    def compiled(self, q: A.Query, params: dict, schema: str | None) -> DataFrame:
        return Compiler(self, self.schema(q.schema or schema), params, self.max_hops).query(q)

    def validate(self, text: str, params: dict | None = None) -> str | None:
        """None if the query compiles, else what is wrong."""
        try:
            q = self.parse(text)
            if isinstance(q, A.Query) and not writes.is_write(q):
                self.compiled(q, checked(params or {}), None).schema
            return None
        except (CypherError, AnalysisException) as e:
            return str(e)

    def explain(self, text: str, params: dict | None = None, mode: str = "formatted") -> None:
        self.cypher(text, params).explain(mode)

    # ------------------------------------------------------------- results

    def rows(self, text: str, params: dict | None = None) -> list[dict]:
        return [r.asDict(recursive=True) for r in self.cypher(text, params).collect()]

    as_dicts = rows

    def to_pandas(self, text: str, params: dict | None = None):
        return self.cypher(text, params).toPandas()

    def to_arrow(self, text: str, params: dict | None = None):
        return self.cypher(text, params).toArrow()

    def export(self, text: str, dest: str, fmt: str | None = None, params: dict | None = None, **options) -> str:
        return write_export(self.cypher(text, params), dest, fmt, options)

    def formatted(self, text: str, fmt: str = "JSONEachRow", params: dict | None = None, limit: int | None = None) -> str:
        """A whole result as text, for people; with `limit`, its first rows."""
        kind = fmt.lower()
        if kind == "graph":
            nodes, edges = self.query_graph(text, params)
            part = lambda df: [r.asDict() | {"properties": json.loads(r.properties or "{}")} for r in (df if limit is None else df.limit(limit)).collect()]
            return json.dumps({"nodes": part(nodes), "edges": part(edges)}, sort_keys=True)
        df = self.cypher(text, params)
        df = df if limit is None else df.limit(limit)
        if kind in ("jsoneachrow", "json"):
            return "\n".join(r[0] for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect())
        if kind in ("csv", "csvwithnames"):
            body = df.toPandas().to_csv(index=False, header=kind == "csvwithnames")
            return body.rstrip("\n")
        if kind in ("pretty", "prettycompact"):
            return df._jdf.showString(limit or df.count(), 0 if kind == "pretty" else 40, False).rstrip("\n")
        raise CypherError(f"unknown format {fmt!r}")

    def query_graph(self, text: str, params: dict | None = None) -> tuple[DataFrame, DataFrame]:
        """The distinct nodes and edges of a result's node, relationship and
        path variables: (label, id, properties), (type, src, dst, properties)."""
        q = self.parse(text)
        comp = Compiler(self, self.schema(q.schema), checked(params or {}), self.max_hops)
        return comp.graph_of(q)

    def store_subgraph(self, text: str, path: str, params: dict | None = None) -> str:
        nodes, edges = self.query_graph(text, params)
        write_export(nodes, f"{path}/nodes", "parquet")
        write_export(edges, f"{path}/edges", "parquet")
        return path

    def create_tables(self, managed: bool = False) -> list[str]:
        """Empty tables, typed by the schema's property_types, for nodes and
        edges whose tables are neither given nor read from a source: frames that
        writes replace, or (managed) tables of Spark's catalog."""
        made: dict[str, dict] = {}
        for d in [*self.schema().nodes.values(), *self.schema().edges]:
            node = hasattr(d, "label")
            if d.source or d.table in self.tables.given or node and d.embedded:
                continue
            ids = d.id if node else (*d.from_id, *d.to_id, *d.edge_id)
            columns = made.setdefault(d.table, {})
            kinds = {c: TYPES.get(str(d.types.get(p, "")).lower()) for p, c in d.props.items()} | {i: TYPES.get(str(d.types.get(i, "")).lower()) for i in ids if i not in d.props.values()}
            extra = [d.label_column] if node else [d.type_column, d.from_label_column, d.to_label_column]
            for c, kind in [*kinds.items(), *((x, "string") for x in extra if x)]:
                columns[c] = kind or columns.get(c) or ("bigint" if c in ids else "string")
        for table, columns in made.items():
            fields = ", ".join(f"`{c}` {kind}" for c, kind in columns.items())
            if managed:
                self.spark.sql(f"CREATE TABLE IF NOT EXISTS `{table}` ({fields}) USING parquet")
            else:
                self.tables.given[table] = self.spark.createDataFrame([], fields)
        return sorted(made)

    def load_subgraph(self, path: str, name: str = "subgraph") -> Graph:
        """A stored subgraph as a graph of its own: one node table and one edge
        table, properties as JSON texts in `properties`."""
        nodes, edges = self.spark.read.parquet(f"{path}/nodes"), self.spark.read.parquet(f"{path}/edges")
        labels = sorted(r[0] for r in nodes.select("label").distinct().collect() if r[0])
        kinds = sorted(r[0] for r in edges.select("type").distinct().collect() if r[0])
        one = lambda x: {"label": x, "table": "nodes", "node_id": "id", "label_column": "label", "label_value": x, "property_mappings": {"id": "id", "properties": "properties"}}
        ends = edges.join(nodes.select(F.col("id").alias("src"), F.col("label").alias("src_label")).distinct(), "src", "left").join(nodes.select(F.col("id").alias("dst"), F.col("label").alias("dst_label")).distinct(), "dst", "left")
        link = {"polymorphic": True, "table": "edges", "from_id": "src", "to_id": "dst", "type_column": "type", "from_label_column": "src_label", "to_label_column": "dst_label", "type_values": kinds, "from_label_values": labels, "to_label_values": labels, "edge_id": "id", "property_mappings": {"properties": "properties"}}
        schema = {"name": name, "graph_schema": {"nodes": [one(x) for x in labels], "edges": [link] if kinds else []}}
        return Graph(self.spark, schema, {"nodes": nodes, "edges": ends})

    # -------------------------------------------------------- direct writes

    def create_nodes(self, label: str, rows: list[dict]) -> int:
        d = self.schema().node(label)
        old = writes.writable(self, d)
        columns = {**{p: c for p, c in d.props.items()}, **{i: i for i in d.id}}
        data = [tuple({columns.get(k, k): v for k, v in r.items()}.get(x.name) for x in old.schema) for r in rows]
        self.tables.given[d.table] = old.unionByName(self.spark.createDataFrame(data, old.schema))
        return len(rows)

    def create_node(self, label: str, **props) -> int:
        return self.create_nodes(label, [props])

    def create_edges(self, kind: str, rows: list[dict]) -> int:
        d = self.schema().edges_of((kind,))[0]
        old = writes.writable(self, d)
        data = [tuple({d.props.get(k, k): v for k, v in r.items()}.get(x.name) for x in old.schema) for r in rows]
        self.tables.given[d.table] = old.unionByName(self.spark.createDataFrame(data, old.schema))
        return len(rows)

    def create_edge(self, kind: str, **values) -> int:
        return self.create_edges(kind, [values])

    def upsert_edges(self, kind: str, rows: list[dict]) -> int:
        """Edges that replace those of the same edge id (or the same ends)."""
        d = self.schema().edges_of((kind,))[0]
        old, ids = writes.writable(self, d), [*(d.edge_id or (*d.from_id, *d.to_id))]
        data = [tuple({d.props.get(k, k): v for k, v in r.items()}.get(x.name) for x in old.schema) for r in rows]
        new = self.spark.createDataFrame(data, old.schema)
        self.tables.given[d.table] = old.join(new.select(*ids), ids, "left_anti").select(*old.columns).unionByName(new)
        return len(rows)

    def delete_edges(self, kind: str, rows: list[dict]) -> int:
        """Deletes the edges with these values of columns or properties."""
        d = self.schema().edges_of((kind,))[0]
        old, names = writes.writable(self, d), sorted({d.props.get(k, k) for k in rows[0]}) if rows else []
        if not names:
            return 0
        gone = self.spark.createDataFrame([tuple({d.props.get(k, k): v for k, v in r.items()}[n] for n in names) for r in rows], old.select(*names).schema).distinct()
        mine = old.where(F.col(d.type_column) == F.lit(d.type)) if d.type_column else old
        n = mine.join(gone, names, "left_semi").count()
        rest = old.join(gone, names, "left_anti").select(*old.columns)
        if d.type_column:
            rest = rest.unionByName(old.where(~F.col(d.type_column).eqNullSafe(F.lit(d.type))).join(gone, names, "left_semi").select(*old.columns))
        self.tables.given[d.table] = rest
        return n

    def load_cypher_create(self, text: str) -> int:
        """Runs CREATE statements, one after another, that `;` parts."""
        n = 0
        for one in statements(text):
            self.cypher(one)
            n += self.counters.get("nodes_created", 0)
        return n

    def upsert_nodes(self, label: str, rows: list[dict]) -> int:
        d = self.schema().node(label)
        old = writes.writable(self, d)
        columns = {**{p: c for p, c in d.props.items()}, **{i: i for i in d.id}}
        data = [tuple({columns.get(k, k): v for k, v in r.items()}.get(x.name) for x in old.schema) for r in rows]
        new = self.spark.createDataFrame(data, old.schema)
        self.tables.given[d.table] = old.join(new.select(*d.id), list(d.id), "left_anti").select(*old.columns).unionByName(new)
        return len(rows)

    def delete_nodes(self, label: str, ids: list) -> dict:
        d = self.schema().node(label)
        names = "n"
        self.cypher(f"MATCH ({names}:`{label}`) WHERE id({names}) IN $ids DETACH DELETE {names}", {"ids": ids}) if len(d.id) == 1 else None
        return self.counters

    def import_json(self, label: str, path: str, **options) -> int:
        return self.import_file(label, path, "json", **options)

    def import_csv(self, label: str, path: str, **options) -> int:
        return self.import_file(label, path, "csv", **options)

    def import_parquet(self, label: str, path: str, **options) -> int:
        return self.import_file(label, path, "parquet", **options)

    def import_file(self, label: str, path: str, fmt: str | None = None, **options) -> int:
        d = self.schema().node(label)
        old = writes.writable(self, d)
        new = read_source(self.spark, path, {**options, **({"format": fmt} if fmt else {})})
        columns = {c: p for p, c in d.props.items()}
        picked = [(F.col(f"`{x.name}`") if x.name in new.columns else F.col(f"`{columns[x.name]}`") if columns.get(x.name) in new.columns else F.lit(None)).cast(x.dataType).alias(x.name) for x in old.schema]
        self.tables.given[d.table] = old.unionByName(new.select(*picked))
        return new.count()

    # ------------------------------------------------------------- catalog

    def nodes(self, label: str) -> DataFrame:
        return node_frame(self.tables, self.schema(), label)

    def edges(self, kind: str) -> DataFrame:
        out = [edge_frame(self.tables, self.schema(), d).df for d in self.schema().edges_of((kind,))]
        base = out[0]
        for x in out[1:]:
            base = base.unionByName(x, allowMissingColumns=True)
        return base

    def register_sources(self) -> list[str]:
        """A temporary view for each node or edge that has a source."""
        made = []
        for d in [*self.schema().nodes.values(), *self.schema().edges]:
            if d.source and d.table not in made:
                read_source(self.spark, d.source).createOrReplaceTempView(d.table)
                made.append(d.table)
        return made

    @staticmethod
    def draft(frames: dict, name: str = "draft") -> dict:
        return draft_schema(frames, name)

    def describe(self) -> str:
        return json.dumps(procedures.schema_map(self, self.schema()), indent=2, sort_keys=True)


def statements(text: str) -> list[str]:
    """The statements of a script; a `;` in quotes parts nothing."""
    out, now, quote = [], "", ""
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote and text[i - 1] != "\\" else quote
        elif c in "'\"`":
            quote = c
        elif c == ";":
            out.append(now)
            now = ""
            continue
        now += c
    return [s for x in [*out, now] if (s := x.strip())]


def checked(params: dict) -> dict:
    """Parameters without numbers that are not finite, at any depth."""

    def visit(k, v):
        if isinstance(v, float) and v - v != 0:
            raise CypherError(f"parameter ${k} is not a finite number")
        for x in v.values() if isinstance(v, dict) else v if isinstance(v, list | tuple) else ():
            visit(k, x)

    for k, v in params.items():
        visit(k, v)
    return params
