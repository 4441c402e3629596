"""From the syntax tree to DataFrames, clause by clause.

The state is a frame (or None before the first clause) and a scope.  Patterns
become joins of node and edge frames; a node's own table is joined only if its
properties are used, as an edge's ends are nodes of the graph.  An OPTIONAL
MATCH is one sub-frame, joined once; patterns in expressions are semi joins,
anti joins or pre-aggregated left joins.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions import aggregate
from graphloom.operators import paths
from graphloom.plans import ast as A
from graphloom.plans.ast import CypherError
from graphloom.plans.expressions import Expr, has_aggregate
from graphloom.plans.scope import Edge, Node, Path, Value, Walk, col
from graphloom.sources.frames import edge_frame, node_frame

MAX_BRANCHES = 500


@dataclass
class Frame:
    df: DataFrame | None
    scope: dict

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys(c for b in self.scope.values() for c in b.columns))


@dataclass
class Oriented:
    """Edges seen from one end: __a is near, __b far."""

    df: DataFrame
    types: tuple
    props: list
    near: dict | None  # embedded properties of the ends
    far: dict | None
    near_labels: set
    far_labels: set


def conjuncts(x) -> list:
    if x is None:
        return []
    if isinstance(x, A.Op) and x.op == "AND":
        return conjuncts(x.args[0]) + conjuncts(x.args[1])
    return [x]


class Compiler:
    def __init__(self, graph, schema, params: dict, max_hops: int = 5) -> None:
        self.graph, self.schema, self.params, self.max_hops = graph, schema, params, max_hops
        self.spark, self.tables, self.count, self.trusted = graph.spark, graph.tables, 0, graph.trusted
        self.used: dict[str, set] = {}
        self.whole: set[str] = set()
        #: parts of the WHERE in work that speak of one unbound node, by its name
        self.pending: dict[str, list] = {}

    # ------------------------------------------------------------- helpers

    def fresh(self, hint: str) -> str:
        self.count += 1
        return f"_{self.count}_{''.join(c if c.isalnum() else '_' for c in hint)[:40]}"

    def expr(self, frame: Frame) -> Expr:
        df = frame.df if frame.df is not None else self.spark.range(1).select(F.lit(1).alias("__one"))
        return Expr(df, frame.scope, self.params)

    def started(self, frame: Frame) -> Frame:
        return frame if frame.df is not None else Frame(self.spark.range(1).select(F.lit(1).alias("__one")), frame.scope)

    def note_uses(self, q) -> None:
        """Which properties each variable name needs, anywhere in the query."""
        ids = {"count", "id", "labels", "label", "type", "elementid", "startnode", "endnode"}

        def visit(x):
            if isinstance(x, A.Prop) and isinstance(x.of, A.Var):
                self.used.setdefault(x.of.name, set()).add(x.key)
            elif isinstance(x, A.Call) and x.name.lower() in ids and len(x.args) == 1 and isinstance(x.args[0], A.Var):
                pass
            elif isinstance(x, A.Op) and x.op in ("=", "<>", "IS NULL", "IS NOT NULL", "IN"):
                for a in x.args:
                    if not isinstance(a, A.Var):
                        visit(a)
            elif isinstance(x, A.Var):
                self.whole.add(x.name)
            elif isinstance(x, A.NodePat | A.RelPat):
                for key in dict(x.props.items) if isinstance(x.props, A.MapOf) else ():
                    self.used.setdefault(x.var, set()).add(key)
                if isinstance(x.props, A.Param):
                    self.whole.add(x.var)
                visit(x.props)
            elif isinstance(x, A.Project):
                if x.star:
                    self.star = True
                for c in A.children(x):
                    visit(c)
            elif isinstance(x, tuple) or hasattr(x, "__dataclass_fields__"):
                for c in A.children(x):
                    visit(c)

        self.star = False
        #: path variables whose nodes are looked into
        self.opened = {a.name for x in A.walk(q) if isinstance(x, A.Call) and x.name.lower() == "nodes" for a in x.args if isinstance(a, A.Var)}
        #: path variables of which only the length is asked
        names = [x.name for x in A.walk(q) if isinstance(x, A.Var)]
        lengths = [a.name for x in A.walk(q) if isinstance(x, A.Call) and x.name.lower() == "length" and len(x.args) == 1 for a in x.args if isinstance(a, A.Var)]
        self.measured = {n for n in lengths if names.count(n) == lengths.count(n)}
        self.costed = {a.name for x in A.walk(q) if isinstance(x, A.Call) and x.name.lower() == "cost" for a in x.args if isinstance(a, A.Var)}
        visit(q)

    def needs(self, var: str | None) -> bool:
        return var is not None and (self.star or var in self.whole or bool(self.used.get(var)))

    def kept(self, var: str | None) -> set | None:
        """The properties of a variable that the query asks for; None: all."""
        if self.star or var in self.whole:
            return None
        own = set(self.used.get(var, ()))
        if var is None or var.startswith("#"):
            if None in self.whole:
                return None
            own |= set(self.used.get(None, ()))
        return own

    # ------------------------------------------------------------- queries

    def query(self, q: A.Query) -> DataFrame:
        out = None
        for i, part in enumerate(q.parts):
            one = self.part(part)
            if out is None:
                out = one
                continue
            if set(out.columns) != set(one.columns):
                raise CypherError(f"UNION branches have different columns: {out.columns} and {one.columns}")
            out = out.unionByName(one)
            if q.unions[i - 1] == "distinct":
                out = out.distinct()
        return out

    def part(self, clauses: tuple) -> DataFrame:
        self.note_uses(clauses)
        frame, last = Frame(None, {}), None
        for i, c in enumerate(clauses):
            last = c
            if isinstance(c, A.Match):
                frame = self.optional(frame, c) if c.optional else self.match(frame, c)
            elif isinstance(c, A.Unwind):
                frame = self.unwind(frame, c)
            elif isinstance(c, A.CallProc):
                frame = self.call(frame, c)
            elif isinstance(c, A.Project):
                if c.kind == "RETURN" and i != len(clauses) - 1:
                    raise CypherError("RETURN must come last")
                frame = self.project(frame, c)
                if c.kind == "RETURN":
                    return self.output(frame, c)
            else:
                raise CypherError(f"{type(c).__name__} is not a read clause")
        if isinstance(last, A.CallProc):
            return self.output(frame, None)
        raise CypherError("the query has no RETURN")

    def output(self, frame: Frame, c: A.Project | None) -> DataFrame:
        """The result's columns; entities as one column a property."""
        cols = []
        for name, b in frame.scope.items():
            if isinstance(b, Node | Edge):
                for p, own in sorted(b.props.items()):
                    cols.append(col(own).alias(f"{name}.{p}"))
                if not b.props:
                    cols.append(col(b.id if isinstance(b, Node) else b.eid).alias(name))
            elif isinstance(b, Path):
                cols.append(F.when(col(b.nodes).isNotNull(), F.struct(col(b.nodes).alias("nodes"), col(b.rels).alias("relationships"))).alias(name))
            else:
                cols.append(col(b.columns[0]).alias(name))
        return frame.df.select(*cols)

    def graph_of(self, q: A.Query) -> tuple[DataFrame, DataFrame]:
        """Distinct nodes and edges among the returned variables."""
        nodes, edges = [], []
        text = lambda c: col(c).cast("string")
        for part in q.parts:
            self.note_uses(part)
            frame = Frame(None, {})
            for c in part:
                if isinstance(c, A.Match):
                    frame = self.optional(frame, c) if c.optional else self.match(frame, c)
                elif isinstance(c, A.Unwind):
                    frame = self.unwind(frame, c)
                elif isinstance(c, A.CallProc):
                    frame = self.call(frame, c)
                elif isinstance(c, A.Project):
                    frame = self.project(frame, c)
            for b in frame.scope.values():
                props = lambda b: F.to_json(F.struct(*(col(c).alias(p) for p, c in sorted(b.props.items())))) if b.props else F.lit("{}")
                if isinstance(b, Node):
                    nodes.append(frame.df.where(col(b.id).isNotNull()).select(col(b.label).alias("label"), text(b.id).alias("id"), props(b).alias("properties")))
                elif isinstance(b, Edge):
                    edges.append(frame.df.where(col(b.eid).isNotNull()).select(col(b.type).alias("type"), text(b.src).alias("src"), text(b.dst).alias("dst"), text(b.eid).alias("id"), props(b).alias("properties")))
                elif isinstance(b, Path):
                    n = frame.df.select(F.explode(col(b.nodes)).alias("n"))
                    nodes.append(n.select("n.__label", "n.__id", F.lit("{}")).toDF("label", "id", "properties"))
                    e = frame.df.select(F.explode(col(b.rels)).alias("e"))
                    edges.append(e.select("e.__type", "e.__src", "e.__dst", "e.__eid", F.lit("{}")).toDF("type", "src", "dst", "id", "properties"))
        none_n = self.spark.createDataFrame([], "label string, id string, properties string")
        none_e = self.spark.createDataFrame([], "type string, src string, dst string, id string, properties string")
        one = lambda frames, none, keys: reduce(lambda a, b: a.unionByName(b), frames, none).groupBy(*keys).agg(F.max("properties").alias("properties"))
        return one(nodes, none_n, ["label", "id"]), one(edges, none_e, ["type", "src", "dst", "id"])

    # ------------------------------------------------------------ patterns

    def labels_of(self, pattern: A.PathPat, scope: dict) -> list[set]:
        """Candidate labels of each node, by propagation over the pattern."""
        out = []
        for n in pattern.items[::2]:
            b = scope.get(n.var) if n.var else None
            if b is not None and not isinstance(b, Node):
                raise CypherError(f"{n.var} is not a node")
            for lab in n.labels:
                self.schema.node(lab)
            labels = set(n.labels) or (set(b.labels) if b else set(self.schema.nodes))
            if b:
                labels &= set(b.labels)
            if isinstance(n.props, A.MapOf) and not n.labels:
                keys = {k for k, _ in n.props.items}
                labels = {x for x in labels if keys <= set(self.schema.node(x).property_names) or self.schema.node(x).discover} or labels
            out.append(labels)
        moved = True
        while moved:
            moved = False
            for i, r in enumerate(pattern.items[1::2]):
                defs = self.schema.edges_of(r.types)
                if r.hops and r.hops[0] == 0:
                    continue
                left, right = set(), set()
                for d in defs:
                    for a, z in self.ends(d, r.direction):
                        a, z = a or set(self.schema.nodes), z or set(self.schema.nodes)
                        far_ok = bool(z & out[i + 1]) or r.hops is not None and r.hops[1] != 1
                        near_ok = bool(a & out[i]) or r.hops is not None and r.hops[1] != 1
                        if far_ok and (a & out[i]):
                            left |= a & out[i]
                        if near_ok and (z & out[i + 1]):
                            right |= z & out[i + 1]
                if left != out[i] or right != out[i + 1]:
                    moved = True
                    out[i], out[i + 1] = left, right
        return out

    @staticmethod
    def ends(d, direction: str):
        a, z = {d.from_label} - {None}, {d.to_label} - {None}
        return [(a, z)] if direction == "out" else [(z, a)] if direction == "in" else [(a, z), (z, a)]

    def oriented(self, r: A.RelPat, near: set, far: set, any_inner: bool = False, names: tuple | None = None) -> Oriented:
        """names: of the near node, the relationship and the far node, whose
        properties are then only those that the query asks for."""
        keep = dict(zip(("near", "rel", "far"), (self.kept(n) for n in names), strict=True)) if names else {"near": None, "rel": None, "far": None}
        if keep["rel"] is not None and r.props is not None:
            keep["rel"] |= {k for k, _ in self.prop_items(r.props)}
        arms, props, near_props, far_props = [], set(), [], []
        defs = self.schema.edges_of(r.types)
        if len(defs) * 2 > MAX_BRANCHES:
            raise CypherError("too many relationship types for one pattern")
        nl, fl = set(), set()
        for d in defs:
            ef, ends = None, {"out": ("near", "far"), "in": ("far", "near")}
            for way, (a, z) in zip(("out", "in") if r.direction == "both" else (r.direction,), self.ends(d, r.direction), strict=True):
                if not any_inner and (a and not a & near or z and not z & far):
                    continue
                if ef is None:
                    both = r.direction == "both" and (keep["near"] is None or keep["far"] is None)
                    k_src, k_dst = (keep["near"] | keep["far"],) * 2 if r.direction == "both" and not both else (None, None) if both else (keep[ends[way][0]], keep[ends[way][1]])
                    ef = edge_frame(self.tables, self.schema, d, keep["rel"], k_src, k_dst)
                s, t, sp, tp = ("__src", "__dst", ef.src_props, ef.dst_props) if way == "out" else ("__dst", "__src", ef.dst_props, ef.src_props)
                df = ef.df.withColumn("__a", F.col(s)).withColumn("__b", F.col(t)).withColumn("__a_label", F.col(f"{s}_label")).withColumn("__b_label", F.col(f"{t}_label"))
                if r.direction == "both" and way == "in" and (d.from_label == d.to_label or None in (d.from_label, d.to_label)):
                    df = df.where((F.col("__src") != F.col("__dst")) | ~F.col("__src_label").eqNullSafe(F.col("__dst_label")))
                if not any_inner:
                    if not a and near < set(self.schema.nodes):
                        df = df.where(F.col("__a_label").isin(sorted(near)))
                    if not z and far < set(self.schema.nodes):
                        df = df.where(F.col("__b_label").isin(sorted(far)))
                arms.append((df, d, sp, tp))
                props |= set(ef.props)
                near_props.append(sp)
                far_props.append(tp)
                nl |= a or near
                fl |= z or far
        if not arms:
            raise CypherError(f"no relationship {'|'.join(r.types) or '(any)'} fits the pattern in schema {self.schema.name!r}")
        embed = lambda ps: sorted(set.intersection(*(set(p) for p in ps))) if all(p is not None for p in ps) and all(set(p) == set(ps[0]) for p in ps) else None
        near_names, far_names = embed(near_props), embed(far_props)
        frames = []
        for df, _, sp, tp in arms:
            base = ["__a", "__b", "__a_label", "__b_label", "__src", "__dst", "__src_label", "__dst_label", "__eid", "__type", *[p for p in sorted(props) if p in df.columns]]
            more = [F.col(f"`{sp[n]}`").alias(f"__near__{n}") for n in near_names or ()] + [F.col(f"`{tp[n]}`").alias(f"__far__{n}") for n in far_names or ()]
            frames.append(df.select(*(F.col(f"`{c}`") for c in base), *more))
        out = unite(frames, ("__a", "__b", "__src", "__dst", "__eid"))
        if r.props is not None:
            for k, v in self.prop_items(r.props):
                if k not in props:
                    raise CypherError(f"unknown relationship property {k!r}")
                out = out.where(F.col(f"`{k}`") == self.expr(Frame(None, {}))(v))
        return Oriented(out, tuple(sorted({d.type for _, d, _, _ in arms})), sorted(props), None if near_names is None else {n: f"__near__{n}" for n in near_names}, None if far_names is None else {n: f"__far__{n}" for n in far_names}, nl & near if not any_inner else near, fl & far if not any_inner else far)

    def prop_items(self, props) -> list:
        if isinstance(props, A.Param):
            v = self.params.get(props.name)
            if not isinstance(v, dict):
                raise CypherError(f"parameter ${props.name} must be a map")
            return [(k, A.Lit(x)) for k, x in v.items()]
        return list(props.items)

    def nodes_frame(self, labels: set, keep: set | None = None) -> DataFrame:
        return unite([node_frame(self.tables, self.schema, x, keep) for x in sorted(labels)], ("__id",))

    def bind_nodes(self, var: str, labels: set) -> tuple[DataFrame, Node]:
        df = self.nodes_frame(labels, self.kept(var))
        if not self.trusted:  # one row an id
            df = df.dropDuplicates(["__id", "__label"])
        ident, lab = self.fresh(f"{var}_id"), self.fresh(f"{var}_label")
        props = {p: self.fresh(f"{var}_{p}") for p in df.columns if p not in ("__id", "__label")}
        out = df.select(F.col("__id").alias(ident), F.col("__label").alias(lab), *(F.col(f"`{p}`").alias(c) for p, c in props.items()))
        return out, Node(ident, lab, tuple(sorted(labels)), props)

    def with_props(self, frame: Frame, n: A.NodePat, var: str) -> Frame:
        """Filters of a node pattern, on a node that is bound by now."""
        b = frame.scope[var]
        df = frame.df
        if n.labels and set(b.labels) - set(n.labels):
            df = df.where(col(b.label).isin(list(n.labels)))
            frame = Frame(df, {**frame.scope, var: replace(b, labels=tuple(sorted(set(b.labels) & set(n.labels))))})
        if n.props is not None:
            for k, v in self.prop_items(n.props):
                df = df.where(self.expr(Frame(df, frame.scope))(A.Op("=", (A.Prop(A.Var(var), k), v))))
        for c in self.pending.pop(var, ()):
            df = df.where(self.expr(Frame(df, frame.scope))(c))
        return Frame(df, frame.scope)

    def weight(self, n: A.NodePat, name: str) -> int:
        """How much is known of a node: equalities most, then other filters."""
        known = 4 * len(self.prop_items(n.props)) if n.props is not None else 0
        for c in self.pending.get(name, ()):
            known += {"=": 4, "IN": 3, "STARTS WITH": 2}.get(c.op, 1) if isinstance(c, A.Op) else 1
        return known

    @staticmethod
    def apart(where, patterns: tuple, scope: dict) -> tuple[dict, list]:
        """The conjuncts of a WHERE that speak of one node that the patterns
        bind, by its name, and the others.  The former filter the node where it
        is bound: before joins, and before a walk or search starts from it."""
        nodes = {n.var for p in patterns for n in p.items[::2] if n.var} - set(scope)
        held, rest = {}, []
        for c in conjuncts(where):
            parts = list(A.walk(c))
            names = {x.name for x in parts if isinstance(x, A.Var)}
            plain = not any(isinstance(x, A.PatternExpr | A.PatternComp) or isinstance(x, A.Call) and x.name.lower() in ("rand", "randomuuid") for x in parts)
            if plain and len(names) == 1 and names <= nodes:
                held.setdefault(names.pop(), []).append(c)
            else:
                rest.append(c)
        return held, rest

    def pattern(self, frame: Frame, p: A.PathPat, edges_seen: list) -> Frame:
        items = list(p.items)
        names = []
        for i, x in enumerate(items):
            names.append(x.var or f"#{i}_{self.fresh('anon')}")
        labels = self.labels_of(p, frame.scope)
        if p.var in self.opened:
            self.whole |= set(names[::2])
        if not all(labels):
            raise CypherError("no label fits the pattern" if not all(labels) else "")
        start = next((i for i in range(0, len(items), 2) if names[i] in frame.scope), None)
        fixed = start is not None
        if start is None:
            start = max(range(0, len(items), 2), key=lambda i: (self.weight(items[i], names[i]), -i))
        if p.kind != "plain":
            return self.shortest(frame, p, items, names, labels)
        steps = [(i, i + 1, i + 2) for i in range(start, len(items) - 2, 2)] + [(i, i - 1, i - 2) for i in range(start, 1, -2)]
        own = frame
        if not fixed:
            own = Frame(None, {})
            if not steps or not self.trusted or self.needs(names[start]) or items[start].props is not None or items[steps[0][1]].hops or any(self.schema.node(x).filter for x in labels[start // 2]) or items[start].var in {x.var for k, x in enumerate(items) if k != start and x.var}:
                first = items[steps[0][1]] if steps else None
                lead = None
                if first is not None and not first.hops:
                    direction = self.turned(first.direction, steps[0][2] > start)
                    lead = self.oriented(replace(first, direction=direction), labels[start // 2], labels[steps[0][2] // 2], names=(names[start], names[steps[0][1]], names[steps[0][2]]))
                if lead is None or lead.near is None or len(labels[start // 2]) > 1:
                    df, node = self.bind_nodes(names[start], labels[start // 2])
                    own = self.with_props(Frame(df, {names[start]: node}), items[start], names[start])
        for near, rel, far in steps:
            own = self.hop(own, items, names, labels, near, rel, far, edges_seen)
        if fixed and not steps:
            own = self.with_props(own, items[start], names[start])
        elif fixed:
            own = self.with_props(own, items[start], names[start])
        if not fixed and frame.df is not None:
            own = Frame(frame.df.crossJoin(own.df), {**frame.scope, **own.scope})
        elif not fixed:
            own = Frame(own.df, {**frame.scope, **own.scope})
        if p.var:
            own = self.bind_path(own, p.var, names)
        return own

    @staticmethod
    def turned(direction: str, forward: bool) -> str:
        return direction if forward or direction == "both" else {"out": "in", "in": "out"}[direction]

    def hop(self, frame: Frame, items, names, labels, near: int, rel: int, far: int, edges_seen: list) -> Frame:
        r = replace(items[rel], direction=self.turned(items[rel].direction, far > near))
        a, z = labels[near // 2], labels[far // 2]
        if r.hops:
            return self.walk(frame, r, items, names, labels, near, rel, far, edges_seen)
        o = self.oriented(r, a, z, names=(names[near], names[rel], names[far]))
        ren = {c: self.fresh(f"{names[rel]}_{c}") for c in o.df.columns}
        e = o.df.select(*(F.col(f"`{c}`").alias(n) for c, n in ren.items()))
        edge = Edge(ren["__eid"], ren["__type"], ren["__src"], ren["__dst"], ren["__src_label"], ren["__dst_label"], o.types, {p: ren[p] for p in o.props})
        if frame.df is None:
            node = Node(ren["__a"], ren["__a_label"], tuple(sorted(o.near_labels)), {p: ren[c] for p, c in (o.near or {}).items()})
            frame = self.with_props(Frame(e, {**frame.scope, names[near]: node}), items[near], names[near])
        else:
            b = frame.scope[names[near]]
            cond = self.same(frame.df, b.id, e, ren["__a"])
            if len(b.labels) > 1 or len(o.near_labels) > 1:
                cond = cond & (col(b.label) == col(ren["__a_label"]))
            if names[far] in frame.scope:
                cond = cond & self.far_condition(frame, names[far], e, ren, o)
            frame = Frame(frame.df.join(e, cond), frame.scope)
        old = frame.scope.get(names[rel])
        if isinstance(old, Edge):
            frame = Frame(frame.df.where(col(old.eid) == col(edge.eid)), frame.scope)
        scope = {**frame.scope, names[rel]: edge}
        df = frame.df
        for other in edges_seen:
            df = self.distinct_edges(df, other, edge)
        edges_seen.append(edge)
        frame = Frame(df, scope)
        if names[far] in frame.scope:
            b = frame.scope[names[far]]
            if ren["__b"] not in (b.id,):
                df = frame.df.where(self.same(frame.df, b.id, frame.df, ren["__b"]))
                if len(b.labels) > 1 or len(o.far_labels) > 1:
                    df = df.where(col(b.label) == col(ren["__b_label"]))
                frame = Frame(df, frame.scope)
            return self.with_props(frame, items[far], names[far])
        return self.with_props(self.attach(frame, names[far], ren["__b"], ren["__b_label"], o.far_labels, {p: ren[c] for p, c in o.far.items()} if o.far is not None else None, items[far].props is not None), items[far], names[far])

    def far_condition(self, frame: Frame, name: str, e: DataFrame, ren: dict, o: Oriented) -> Column:
        b = frame.scope[name]
        cond = self.same(frame.df, b.id, e, ren["__b"])
        if len(b.labels) > 1 or len(o.far_labels) > 1:
            cond = cond & (col(b.label) == col(ren["__b_label"]))
        return cond

    def attach(self, frame: Frame, name: str, ident: str, label: str, labels: set, embedded: dict | None, filtered: bool) -> Frame:
        """Bind the node at the far end of an edge or walk."""
        plain = not any(self.schema.node(x).filter for x in labels)
        if embedded is not None and len(labels) == 1:
            return Frame(frame.df, {**frame.scope, name: Node(ident, label, tuple(labels), embedded)})
        if self.trusted and not self.needs(name) and not filtered and plain:
            return Frame(frame.df, {**frame.scope, name: Node(ident, label, tuple(sorted(labels)), {})})
        df, node = self.bind_nodes(name, labels)
        cond = self.same(frame.df, ident, df, node.id)
        if len(labels) > 1:
            cond = cond & (col(label) == col(node.label))
        return Frame(frame.df.join(df, cond), {**frame.scope, name: node})

    @staticmethod
    def same(left: DataFrame, a: str, right: DataFrame, b: str) -> Column:
        ka, kb = left.schema[a].dataType, right.schema[b].dataType
        if ka == kb or isinstance(ka, T.NumericType) and isinstance(kb, T.NumericType):
            return col(a) == col(b)
        return col(a).cast("string") == col(b).cast("string")

    def distinct_edges(self, df: DataFrame, one, two) -> DataFrame:
        if isinstance(one, Walk) and isinstance(two, Walk):
            keys = lambda w: F.transform(col(w.rels), lambda r: F.struct(r["__type"], r["__eid"]))
            return df.where(~F.arrays_overlap(keys(one), keys(two)) | (F.size(col(one.rels)) == 0) | (F.size(col(two.rels)) == 0))
        if isinstance(one, Walk):
            one, two = two, one
        if isinstance(two, Walk):
            return df.where(~F.exists(col(two.rels), lambda r: (r["__eid"] == col(one.eid).cast("string")) & (r["__type"] == col(one.type))))
        if not set(one.types) & set(two.types):
            return df
        differ = ~self.same(df, one.eid, df, two.eid)
        if len(one.types) > 1 or len(two.types) > 1:
            differ = differ | (col(one.type) != col(two.type))
        return df.where(differ)

    # --------------------------------------------------------------- walks

    def path_edges(self, r: A.RelPat, near: set, far: set) -> Oriented:
        o = self.oriented(r, near, far, any_inner=True)
        ident = F.concat_ws("|", F.col("__type"), F.col("__eid").cast("string"))
        rel = F.struct(F.col("__type"), F.col("__eid").cast("string").alias("__eid"), F.col("__src").cast("string").alias("__src"), F.col("__dst").cast("string").alias("__dst"), *(F.col(f"`{p}`") for p in o.props))
        return replace(o, df=o.df.select("__a", "__b", "__a_label", "__b_label", ident.alias("__eid"), rel.alias("__rel")))

    def walk_ends(self, frame: Frame, name: str) -> tuple[DataFrame, Node]:
        b = frame.scope[name]
        return frame.df.where(col(b.id).isNotNull()).select(col(b.id).alias("__start"), col(b.label).alias("__start_label")).distinct(), b

    def back_join(self, frame: Frame, found: DataFrame, near: Node, names, items, labels, rel: int, far: int, how: str = "inner") -> Frame:
        """Walks (__start ...) joined to the rows that they started from."""
        ren = {c: self.fresh(f"{names[rel]}{c}") for c in ("__start", "__start_label", "__end", "__end_label", "__rels", "__nodes")}
        e = found.select(*(F.col(c).alias(n) for c, n in ren.items()))
        cond = self.same(frame.df, near.id, e, ren["__start"]) & col(near.label).eqNullSafe(col(ren["__start_label"]))
        if names[far] in frame.scope:
            b = frame.scope[names[far]]
            cond = cond & self.same(frame.df, b.id, e, ren["__end"]) & (col(b.label) == F.coalesce(col(ren["__end_label"]), col(b.label)))
        scope = {**frame.scope, names[rel]: Walk(ren["__rels"]), f"@{names[rel]}": Path(ren["__nodes"], ren["__rels"])}
        df = frame.df.join(e, cond, how)
        out = Frame(df, scope)
        if names[far] not in frame.scope:
            want = labels[far // 2]
            if set(want) < set(self.schema.nodes):
                out = Frame(df.where(col(ren["__end_label"]).isin(sorted(want)) | col(ren["__end_label"]).isNull()), scope)
            out = self.attach(out, names[far], ren["__end"], ren["__end_label"], want, None, items[far].props is not None)
        return self.with_props(out, items[far], names[far])

    def walk(self, frame: Frame, r, items, names, labels, near: int, rel: int, far: int, edges_seen: list) -> Frame:
        least, most = r.hops
        most = max(self.max_hops, least) if most is None else most
        if frame.df is None:
            df, node = self.bind_nodes(names[near], labels[near // 2])
            frame = self.with_props(Frame(df, {names[near]: node}), items[near], names[near])
        defs = self.schema.edges_of(r.types)
        chained = any(not z or not a or z & a for d in defs for _, z in self.ends(d, r.direction) for e in defs for a, _ in self.ends(e, r.direction))
        if not chained and least > 1:
            raise CypherError(f"{'|'.join(r.types) or 'no type'} can't follow itself, so a path of {least} hops is impossible")
        most = most if chained else min(most, 1)
        o = self.path_edges(r, labels[near // 2], labels[far // 2])
        starts, b = self.walk_ends(frame, names[near])
        found = paths.walks(starts, o.df, least, most)
        if names[near] in self.whole and names[near].startswith("#") or names[near] in self.whole and self.opened:
            found = paths.with_properties(found, self.nodes_frame(labels[near // 2] | labels[far // 2]))
        if far < near:
            found = found.withColumn("__nodes", F.reverse("__nodes")).withColumn("__rels", F.reverse("__rels"))
        out = self.back_join(frame, found, b, names, items, labels, rel, far)
        w = out.scope[names[rel]]
        df = out.df
        for other in edges_seen:
            df = self.distinct_edges(df, other, w)
        edges_seen.append(w)
        return Frame(df, out.scope)

    def weighted(self, frame: Frame, p: A.PathPat, items, names, labels) -> Frame:
        """A shortest path over the weights that a WITH has exported as
        source, target and weight; cost(p) is its sum."""
        w = {k: frame.scope[k].name for k in ("source", "target", "weight")}
        edges = paths.stored(frame.df.select(*(col(c).alias(k) for k, c in w.items())).distinct(), "weights")
        ends = []
        for i in (0, 2):
            df, node = self.bind_nodes(names[i], labels[i // 2])
            ends.append(self.with_props(Frame(df, {names[i]: node}), items[i], names[i]))
        a, z = ends[0].scope[names[0]], ends[1].scope[names[2]]
        best = paths.weighted_all(edges, ends[0].df.select(col(a.id).alias("__start")).distinct())
        s, t, c, n, r = (self.fresh(x) for x in ("start", "end", "cost", "nodes", "rels"))
        point = lambda x: F.struct(F.lit(None).cast("string").alias("__label"), x.cast("string").alias("__id"))
        nodes, rels = F.transform("path", point), F.transform(F.slice("path", F.lit(2), F.size("path") - 1), lambda x: F.struct(x.cast("string").alias("__dst")))
        best = best.where(F.size("path") > 1).select(F.col("__start").alias(s), F.col("node").alias(t), F.col("cost").alias(c), nodes.alias(n), rels.alias(r))
        df = ends[0].df.join(best, self.same(ends[0].df, a.id, best, s))
        df = df.join(ends[1].df, self.same(df, t, ends[1].df, z.id))
        return Frame(df, {**ends[0].scope, **ends[1].scope, p.var: Path(n, r, c)})

    def shortest(self, frame: Frame, p: A.PathPat, items, names, labels) -> Frame:
        if p.var in self.costed and {"source", "target", "weight"} <= set(frame.scope):
            return self.weighted(frame, p, items, names, labels)
        known = [names[i] in frame.scope for i in (0, 2)]
        if known[0] == known[1]:  # from the side of which more is known
            near, far = (0, 2) if known[0] or self.weight(items[0], names[0]) >= self.weight(items[2], names[2]) else (2, 0)
        else:
            near, far = (0, 2) if known[0] else (2, 0)
        r = replace(items[1], direction=self.turned(items[1].direction, far > near))
        least, most = r.hops or (1, 1)
        most = max(self.max_hops, least) if most is None else most
        if names[near] in frame.scope:
            frame = self.with_props(frame, items[near], names[near])
        else:
            df, node = self.bind_nodes(names[near], labels[near // 2])
            one = self.with_props(Frame(df, {names[near]: node}), items[near], names[near])
            frame = one if frame.df is None else Frame(frame.df.crossJoin(one.df), {**frame.scope, **one.scope})
        goals = None
        if names[far] in frame.scope:
            frame = self.with_props(frame, items[far], names[far])
            goals = self.walk_ends(frame, names[far])[0]
        elif items[far].props is not None or names[far] in self.pending:
            df, node = self.bind_nodes(names[far], labels[far // 2])
            goals = self.walk_ends(self.with_props(Frame(df, {names[far]: node}), items[far], names[far]), names[far])[0]
        o = self.path_edges(r, labels[near // 2], labels[far // 2])
        starts, b = self.walk_ends(frame, names[near])
        # without any use of its parts a path is no more than its length
        light = p.kind != "all_shortest" and (p.var is None or p.var in self.measured) and not self.needs(items[1].var)
        found = paths.shortest(starts, o.df, least, most, p.kind == "all_shortest", goals, light)
        if p.var in self.opened:
            found = paths.with_properties(found, self.nodes_frame(labels[0] | labels[1]))
        if far < near and not light:
            found = found.withColumn("__nodes", F.reverse("__nodes")).withColumn("__rels", F.reverse("__rels"))
        out = self.back_join(frame, found, b, names, items, labels, 1, far)
        return self.bind_path(out, p.var, names) if p.var else out

    def bind_path(self, frame: Frame, var: str, names: list) -> Frame:
        """nodes and relationships of a path, from its parts."""
        if len(names) == 3 and f"@{names[1]}" in frame.scope:
            b = frame.scope[f"@{names[1]}"]
            return Frame(frame.df, {**frame.scope, var: b})
        held = [frame.scope[x] for x in names[::2]]
        props = sorted({k for n in held for k in n.props}) if var in self.opened else []
        value = lambda n, k: col(n.props[k]) if k in n.props else F.lit(None)
        node_of = lambda n: F.array(F.struct(col(n.label).alias("__label"), col(n.id).cast("string").alias("__id"), *(value(n, k).alias(k) for k in props)))
        rel_of = lambda e: F.array(F.struct(col(e.type).alias("__type"), col(e.eid).cast("string").alias("__eid"), col(e.src).cast("string").alias("__src"), col(e.dst).cast("string").alias("__dst")))
        nodes, rels = node_of(frame.scope[names[0]]), None
        for i in range(1, len(names), 2):
            b = frame.scope[names[i]]
            if isinstance(b, Walk):
                w = frame.scope[f"@{names[i]}"]
                nodes = F.concat(nodes, F.slice(col(w.nodes), F.lit(2), F.greatest(F.size(col(w.nodes)) - 1, F.lit(0))))
                own = F.transform(col(w.rels), lambda r: F.struct(r["__type"].alias("__type"), r["__eid"].alias("__eid"), r["__src"].alias("__src"), r["__dst"].alias("__dst")))
            else:
                nodes = F.concat(nodes, node_of(frame.scope[names[i + 1]]))
                own = rel_of(b)
            rels = own if rels is None else F.concat(rels, own)
        if rels is None:
            rels = F.array().cast("array<struct<__type:string,__eid:string,__src:string,__dst:string>>")
        a, b = self.fresh(f"{var}_nodes"), self.fresh(f"{var}_rels")
        return Frame(frame.df.withColumn(a, nodes).withColumn(b, rels), {**frame.scope, var: Path(a, b)})

    # --------------------------------------------------------------- match

    def match(self, frame: Frame, m: A.Match) -> Frame:
        return self.tidied(self.matched(frame, m.patterns, m.where))

    def matched(self, frame: Frame, patterns: tuple, where, path: str | None = None) -> Frame:
        """Patterns one after another, and the WHERE as early as it can be."""
        seen: list = []
        outer = self.pending
        self.pending, rest = self.apart(where, patterns, frame.scope)
        for p in self.ordered(patterns, frame.scope):
            frame = self.pattern(frame, A.PathPat(path or p.var, p.items, p.kind), seen)
        rest += [c for own in self.pending.values() for c in own]
        self.pending = outer
        return self.where(frame, rest)

    @staticmethod
    def ordered(patterns: tuple, scope: dict) -> list:
        """Patterns so that each, if it can, shares a variable with before."""
        left, known, out = list(patterns), set(scope), []
        while left:
            p = next((x for x in left if any(i.var in known for i in x.items if i.var)), left[0])
            left.remove(p)
            known |= {i.var for i in p.items if i.var}
            out.append(p)
        return out

    def tidied(self, frame: Frame) -> Frame:
        """Drop what only the pattern itself needed."""
        scope = {k: v for k, v in frame.scope.items() if not k.startswith(("#", "@"))}
        out = Frame(frame.df, scope)
        cols = out.columns
        return Frame(frame.df.select(*(col(c) for c in cols)) if cols else frame.df.select(F.lit(1).alias("__one")), scope)

    def where(self, frame: Frame, x) -> Frame:
        for c in x if isinstance(x, list) else conjuncts(x):
            inner, no = (c.args[0], True) if isinstance(c, A.Op) and c.op == "NOT" else (c, False)
            if isinstance(inner, A.PatternExpr) and inner.kind == "exists":
                frame = self.semi(frame, inner, no)
                continue
            frame, c = self.lifted(frame, c)
            frame = self.started(frame)
            frame = Frame(frame.df.where(self.expr(frame)(c)), frame.scope)
        return frame

    def sub_pattern(self, frame: Frame, patterns: tuple, where, value=None, path: str | None = None):
        """A pattern in an expression, per distinct row of what it uses from
        outside.  Returns (frame of the sub-rows, key columns)."""
        names = {x.name for x in A.walk((where, value)) if isinstance(x, A.Var)} | {i.var for p in patterns for i in p.items if i.var}
        names |= {x.name for p in patterns for x in A.walk(tuple(i.props for i in p.items)) if isinstance(x, A.Var)}
        outer = {n: frame.scope[n] for n in names if n in frame.scope}
        saved = self.used, set(self.whole)
        if value is not None or where is not None:
            self.note_more((where, value))
        if outer:
            simple = [b for n, b in outer.items() if isinstance(b, Node) and not (n in {x.of.name for x in A.walk((where, value)) if isinstance(x, A.Prop) and isinstance(x.of, A.Var)})]
            keys = []
            for b in outer.values():
                keys += [b.id, b.label] if b in simple else b.columns
            keys = list(dict.fromkeys(keys))
            base = Frame(frame.df.select(*(col(k) for k in keys)).distinct(), {n: replace(b, props={}) if b in simple else b for n, b in outer.items()})
        else:
            keys, base = [], Frame(None, {})
        base = self.matched(base, patterns, where, path)
        self.used, self.whole = saved
        return base, keys

    def note_more(self, x) -> None:
        for n in A.walk(x):
            if isinstance(n, A.Prop) and isinstance(n.of, A.Var):
                self.used.setdefault(n.of.name, set()).add(n.key)

    def key_join(self, frame: Frame, sub: DataFrame, keys: list[str], how: str) -> DataFrame:
        ren = {k: self.fresh("key") for k in keys}
        cols = [col(c).alias(ren.get(c, c)) for c in sub.columns]
        sub = sub.select(*cols)
        cond = reduce(lambda p, q: p & q, [col(k).eqNullSafe(col(r)) for k, r in ren.items()]) if keys else F.lit(True)
        out = frame.df.join(sub, cond, how)
        return out.drop(*ren.values()) if how not in ("left_semi", "left_anti") else out

    def semi(self, frame: Frame, x: A.PatternExpr, no: bool) -> Frame:
        frame = self.started(frame)
        sub, keys = self.sub_pattern(frame, x.patterns, x.where)
        rows = sub.df.select(*(col(k) for k in keys)).distinct() if keys else sub.df.select(F.lit(1).alias("__any")).limit(1)
        return Frame(self.key_join(frame, rows, keys, "left_anti" if no else "left_semi"), frame.scope)

    def lifted(self, frame: Frame, x):
        """Turn patterns inside an expression into columns of the frame."""
        found: dict = {}

        def visit(n):
            if isinstance(n, A.Call) and n.name.lower() in ("sum", "min", "max", "avg", "size", "count") and len(n.args) == 1 and isinstance(n.args[0], A.PatternComp):
                found.setdefault(n, A.Col(self.fresh("pattern")))
                return found[n]
            if isinstance(n, A.PatternExpr | A.PatternComp):
                found.setdefault(n, A.Col(self.fresh("pattern")))
                return found[n]
            return None

        x = A.rebuild(x, visit)
        for n, c in found.items():
            frame = self.started(frame)
            kind, comp = (n.name.lower(), n.args[0]) if isinstance(n, A.Call) else (n.kind if isinstance(n, A.PatternExpr) else "list", n)
            patterns = comp.patterns if isinstance(comp, A.PatternExpr) else (comp.pattern,)
            value = getattr(comp, "value", None)
            sub, keys = self.sub_pattern(frame, patterns, comp.where, value, getattr(comp, "path", None))
            if kind in ("exists", "count", "size") and (value is None or kind == "size"):
                agg = F.count(F.lit(1))
            else:
                v = self.expr(sub)(value)
                agg = {"list": F.collect_list, "sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg, "count": F.count}[kind](v)
            rows = sub.df.groupBy(*(col(k) for k in keys)).agg(agg.alias(c.name)) if keys else sub.df.agg(agg.alias(c.name))
            df = self.key_join(frame, rows, keys, "left")
            if kind in ("count", "size", "exists"):
                df = df.withColumn(c.name, F.coalesce(col(c.name), F.lit(0)))
                if kind == "exists":
                    df = df.withColumn(c.name, col(c.name) > 0)
            elif kind == "list":
                df = df.withColumn(c.name, F.coalesce(col(c.name), F.array().cast(df.schema[c.name].dataType)))
            elif kind == "sum":
                df = df.withColumn(c.name, F.coalesce(col(c.name), F.lit(0)))
            frame = Frame(df, frame.scope)
        return frame, x

    def optional(self, frame: Frame, m: A.Match) -> Frame:
        """The whole optional part, WHERE included, joined once."""
        if frame.df is None:
            frame = self.started(frame)
        sub, keys = self.sub_pattern(frame, m.patterns, m.where, None)
        new = {k: v for k, v in sub.scope.items() if k not in frame.scope and not k.startswith(("#", "@"))}
        cols = list(dict.fromkeys(c for b in new.values() for c in b.columns))
        rows = sub.df.select(*(col(c) for c in [*keys, *cols]))
        return Frame(self.key_join(frame, rows, keys, "left"), {**frame.scope, **new})

    # ------------------------------------------------------ unwind and call

    def unwind(self, frame: Frame, c: A.Unwind) -> Frame:
        frame, of = self.lifted(self.started(frame), c.of)
        name = self.fresh(c.var)
        e = self.expr(frame)
        listed = e(of)
        kind = e.dtype(listed)
        if not isinstance(kind, T.ArrayType):
            listed = F.when(listed.isNotNull(), F.array(listed))
        df = frame.df.select("*", F.explode(listed).alias(name))
        return Frame(df, {**frame.scope, c.var: Value(name)})

    def call(self, frame: Frame, c: A.CallProc) -> Frame:
        from graphloom.operators.procedures import call_procedure

        e = self.expr(frame)
        args = [(k, self.constant_of(v, e)) for k, v in c.args]
        df, node = call_procedure(self.graph, self.schema, c.name, args)
        yields = dict(c.yields) or {n: n for n in [*(["node"] if node else []), *[x for x in df.columns if not node or x not in node.columns]]}
        scope = {}
        for column, alias in yields.items():
            if node is not None and column == "node":
                scope[alias] = node
            elif column in df.columns:
                own = self.fresh(alias)
                df = df.withColumn(own, F.col(f"`{column}`"))
                scope[alias] = Value(own)
            else:
                raise CypherError(f"procedure {c.name} yields no {column!r}")
        df = df if frame.df is None else frame.df.crossJoin(df)
        return self.where(Frame(df, {**frame.scope, **scope}), c.where)

    def constant_of(self, x, e: Expr):
        if isinstance(x, A.Lit):
            return x.value
        if isinstance(x, A.Param):
            if x.name not in self.params:
                raise CypherError(f"missing parameter ${x.name}")
            return self.params[x.name]
        if isinstance(x, A.ListOf):
            return [self.constant_of(i, e) for i in x.items]
        if isinstance(x, A.MapOf):
            return {k: self.constant_of(v, e) for k, v in x.items}
        if isinstance(x, A.Var):
            return x.name
        return e.constant(e(x))

    # ---------------------------------------------------------- projection

    def number(self, x, what: str) -> int:
        v = self.constant_of(x, self.expr(Frame(None, {})))
        if not isinstance(v, int) or v < 0:
            raise CypherError(f"{what} must be a non-negative integer")
        return v

    def project(self, frame: Frame, c: A.Project) -> Frame:
        items = list(c.items)
        if c.star:
            named = {i.name for i in items}
            items = [A.Item(A.Var(n), n, True) for n in frame.scope if n not in named and not n.startswith(("#", "@"))] + items
            if not items:
                raise CypherError("nothing to project")
        frame = self.started(frame)
        swapped = []
        for i in items:
            frame, v = self.lifted(frame, i.value)
            swapped.append(A.Item(v, i.name, i.aliased))
        order = []
        for x, up in c.order:
            x = self.known_as(x, items)
            frame, x = self.lifted(frame, x)
            order.append((x, up))
        aggregated = any(has_aggregate(i.value) for i in swapped)
        if aggregated:
            frame, scope, order = self.grouped(frame, swapped, order)
            merged = scope
        else:
            scope, new = {}, {}
            e = self.expr(frame)
            for i in swapped:
                b = frame.scope.get(i.value.name) if isinstance(i.value, A.Var) else None
                if b is not None and not (isinstance(b, Value) and c.distinct):
                    scope[i.name] = b
                else:
                    own = self.fresh(i.name)
                    new[own] = e(i.value)
                    scope[i.name] = Value(own)
            if new:
                frame = Frame(frame.df.select("*", *(v.alias(k) for k, v in new.items())), frame.scope)
            merged = {**frame.scope, **scope}
        df = frame.df
        if c.distinct:
            keep = Frame(df, scope).columns
            df = df.select(*(col(k) for k in keep)).distinct()
            merged = scope
        if order:
            e = Expr(df, merged, self.params)
            keys = []
            for x, up in order:
                k = e.identity(x) if isinstance(x, A.Var) else e(x)
                keys.append(k.asc_nulls_last() if up else k.desc_nulls_first())
            df = df.orderBy(*keys)
        if c.skip is not None:
            df = df.offset(self.number(c.skip, "SKIP"))
        if c.limit is not None:
            df = df.limit(self.number(c.limit, "LIMIT"))
        if c.where is not None and not aggregated and not c.distinct:
            out = self.where(Frame(df, {**merged}), c.where)
            out = Frame(out.df, scope)
        else:
            out = self.where(Frame(df, scope), c.where)
        keep = out.columns
        return Frame(out.df.select(*(col(k) for k in keep)), scope)

    @staticmethod
    def known_as(x, items: list):
        """An ORDER BY term with projected terms replaced by their names."""
        by_value = {i.value: A.Var(i.name) for i in items}
        names = {i.name for i in items}
        return A.rebuild(x, lambda n: by_value.get(n) if not (isinstance(n, A.Var) and n.name in names) and not isinstance(n, A.Lit) and n in by_value else None)

    def grouped(self, frame: Frame, items: list, order: list):
        e = self.expr(frame)
        keys: dict[str, Column] = {}
        firsts: dict[str, Column] = {}
        aggs: dict = {}
        key_cols: dict = {}
        scope: dict = {}

        def as_key(value, hint: str) -> str:
            if value not in key_cols:
                own = self.fresh(hint)
                keys[own] = e(value)
                key_cols[value] = own
            return key_cols[value]

        def entity_key(b) -> None:
            ids = [b.id, b.label] if isinstance(b, Node) else [b.eid, b.type, b.src, b.dst, b.src_label, b.dst_label] if isinstance(b, Edge) else b.columns
            for k in ids:
                keys.setdefault(k, col(k))
            for k in b.columns:
                if k not in ids:
                    firsts.setdefault(k, F.first(col(k)))

        def swap(n):
            if isinstance(n, A.CountStar) or isinstance(n, A.Call) and has_aggregate(n) and not any(has_aggregate(a) for a in n.args):
                if n not in aggs:
                    aggs[n] = self.fresh("agg")
                return A.Col(aggs[n])
            if isinstance(n, A.Var) and n.name in frame.scope:
                b = frame.scope[n.name]
                if isinstance(b, Value):
                    return A.Col(as_key(n, n.name))
                entity_key(b)
                return n
            if isinstance(n, A.Prop) and isinstance(n.of, A.Var) and n.of.name in frame.scope and isinstance(frame.scope[n.of.name], Node | Edge):
                return A.Col(as_key(n, n.key))
            return None

        later = {}
        for i in items:
            if has_aggregate(i.value):
                later[i.name] = A.rebuild(i.value, swap)
            elif isinstance(i.value, A.Var) and not isinstance(frame.scope.get(i.value.name), Value | None):
                entity_key(frame.scope[i.value.name])
                scope[i.name] = frame.scope[i.value.name]
            else:
                scope[i.name] = Value(as_key(i.value, i.name))
        order = [(A.rebuild(x, swap) if has_aggregate(x) else x, up) for x, up in order]
        cols = []
        for n, c in aggs.items():
            if isinstance(n, A.Call) and n.name.lower() == "percentiledisc" and not n.distinct and len(n.args) == 2:
                value, own = e(n.args[0]), self.fresh("ordered")
                kind = e.dtype(value)
                if isinstance(kind, T.NumericType):
                    frame = Frame(frame.df.withColumn(own, value), frame.scope)
                    cols.append(aggregate.ordered_percentile(own, self.constant_of(n.args[1], e), kind).alias(c))
                    continue
            cols.append(e(n).alias(c))
        cols += [c.alias(k) for k, c in firsts.items()]
        if not cols:
            cols = [F.lit(1).alias("__one")]
        df = frame.df.groupBy(*(c.alias(k) for k, c in keys.items())).agg(*cols) if keys else frame.df.agg(*cols)
        inside = Expr(df, {k: v for k, v in frame.scope.items() if all(x in df.columns for x in v.columns)}, self.params)
        for name, x in later.items():
            own = self.fresh(name)
            df = df.withColumn(own, inside(x))
            scope[name] = Value(own)
        scope = {i.name: scope[i.name] for i in items}
        return Frame(df, scope), scope, order


def unite(frames: list[DataFrame], ids: tuple) -> DataFrame:
    """Frames of several labels or types; ids of different kinds as text."""
    if len(frames) == 1:
        return frames[0]
    for i in ids:
        kinds = {f.schema[i].dataType.simpleString() for f in frames}
        if len(kinds) > 1:
            numeric = kinds <= {"int", "bigint", "smallint", "tinyint"}
            frames = [f.withColumn(i, F.col(i).cast("bigint" if numeric else "string")) for f in frames]
    names = {}
    for f in frames:
        for x in f.schema:
            names.setdefault(x.name, set()).add(x.dataType.simpleString())
    for n, kinds in names.items():
        if len(kinds) > 1 and n not in ids:
            numeric = kinds <= {"int", "bigint", "smallint", "tinyint", "double", "float"}
            frames = [f.withColumn(n, F.col(f"`{n}`").cast("double" if numeric and kinds & {"double", "float"} else "bigint" if numeric else "string")) if n in f.columns else f for f in frames]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
