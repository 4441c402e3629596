"""Expressions as Spark columns over the row frame."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions import aggregate, scalar
from graphloom.plans import ast as A
from graphloom.plans.ast import CypherError
from graphloom.plans.scope import Edge, Node, Path, Value, Walk, col

INTEGRAL = scalar.INTEGRAL
TEMPORAL = {"year", "month", "day", "hour", "minute", "second", "dayofweek", "dayofyear", "quarter", "week", "epochmillis", "epochseconds"}


def element_id(n: Node) -> Column:
    return F.concat(col(n.label), F.lit(":"), as_text(col(n.id)))


def as_text(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c.cast("string"), r"^\{|\}$", ""), ", ", "|")


def node_struct(n: Node) -> Column:
    return F.when(col(n.id).isNotNull(), F.struct(col(n.id).alias("__id"), col(n.label).alias("__label"), *(col(c).alias(p) for p, c in sorted(n.props.items()))))


def edge_struct(e: Edge) -> Column:
    return F.when(col(e.eid).isNotNull(), F.struct(col(e.eid).alias("__eid"), col(e.type).alias("__type"), col(e.src).alias("__src"), col(e.dst).alias("__dst"), *(col(c).alias(p) for p, c in sorted(e.props.items()))))


class Expr:
    """Compiles expressions against one frame and scope."""

    def __init__(self, df: DataFrame, scope: dict, params: dict, local: dict | None = None) -> None:
        self.df, self.scope, self.params, self.local = df, scope, params, local or {}
        #: stand-ins of lambda variables, and columns whose types are known
        self.typed: dict = {}
        self.known: dict = {}

    # --------------------------------------------------------------- types

    def dtype(self, c: Column) -> T.DataType:
        """The column's type; NullType where it can't be told in a lambda."""
        if id(c) in self.known:
            return self.known[id(c)][1]
        if self.local:
            return T.NullType()
        try:
            return self.df.select(c.alias("x")).schema[0].dataType
        except AnalysisException:
            return T.NullType()

    def noted(self, x, c: Column) -> Column:
        """Inside a lambda, remember the type that x has."""
        if self.local:
            shadow = Expr(self.df, self.scope, self.params)
            shadow.scope = {**self.scope, **self.typed}
            try:
                self.known[id(c)] = (c, shadow.dtype(shadow(x)))
            except Exception:
                self.known[id(c)] = (c, T.NullType())
        return c

    def constant(self, c: Column):
        rows = self.df.sparkSession.range(1).select(c.alias("x")).collect()
        return rows[0][0]

    def integral(self, x, c: Column) -> bool:
        if isinstance(x, A.Lit):
            return type(x.value) is int
        return isinstance(self.dtype(c), INTEGRAL)

    # --------------------------------------------------------------- terms

    def __call__(self, x) -> Column:
        name = type(x).__name__
        f = getattr(self, "on_" + name.lower(), None)
        if f is None:
            raise CypherError(f"{name} can't stand in an expression here")
        return f(x)

    def on_column(self, x: Column) -> Column:
        return x

    def on_col(self, x: A.Col) -> Column:
        return col(x.name)

    def literal(self, v) -> Column:
        if isinstance(v, list | tuple):
            return self.array([self.literal(i) for i in v], list(v))
        if isinstance(v, dict):
            return F.struct(*(self.literal(i).alias(k) for k, i in v.items()))
        if isinstance(v, int) and not isinstance(v, bool):
            return F.lit(v).cast("long")
        return F.lit(v)

    def on_lit(self, x: A.Lit) -> Column:
        return self.literal(x.value)

    def on_param(self, x: A.Param) -> Column:
        if x.name not in self.params:
            raise CypherError(f"missing parameter ${x.name}")
        return self.literal(self.params[x.name])

    def array(self, cols: list[Column], values: list | None = None) -> Column:
        """Lists of mixed kinds become lists of strings."""
        if not cols:
            return F.array()
        kinds = {type(v) for v in values if v is not None} if values is not None else {type(self.dtype(c)) for c in cols} - {T.NullType}
        numbers = {int, float, *scalar.NUMERIC}
        if len(kinds) > 1 and not kinds <= numbers:
            return F.array(*(c.cast("string") for c in cols))
        return F.array(*cols)

    def on_listof(self, x: A.ListOf) -> Column:
        return self.array([self(i) for i in x.items])

    def on_mapof(self, x: A.MapOf) -> Column:
        return F.struct(*(self(v).alias(k) for k, v in x.items)) if x.items else F.create_map()

    def bound(self, name: str):
        if name not in self.scope:
            raise CypherError(f"variable {name!r} is not defined")
        return self.scope[name]

    def on_var(self, x: A.Var) -> Column:
        if x.name in self.local:
            return self.local[x.name]
        b = self.bound(x.name)
        if isinstance(b, Column):
            return b
        if isinstance(b, Node):
            return node_struct(b)
        if isinstance(b, Edge):
            return edge_struct(b)
        if isinstance(b, Walk):
            return col(b.rels)
        if isinstance(b, Path):
            return F.when(col(b.nodes).isNotNull(), F.struct(col(b.nodes).alias("nodes"), col(b.rels).alias("relationships")))
        return col(b.name)

    def on_prop(self, x: A.Prop) -> Column:
        if isinstance(x.of, A.Var) and x.of.name not in self.local:
            b = self.bound(x.of.name)
            if isinstance(b, Node | Edge):
                return col(b.props[x.key]) if x.key in b.props else F.lit(None)
            if isinstance(b, Path | Walk):
                raise CypherError(f"{x.of.name} has no property {x.key}")
        base = self.noted(x.of, self(x.of))
        kind = self.dtype(base)
        if isinstance(kind, T.StructType):
            return base[x.key] if x.key in kind.names else F.lit(None)
        if isinstance(kind, T.MapType):
            return F.try_element_at(base, F.lit(x.key))
        if x.key.lower() in TEMPORAL and not isinstance(kind, T.NullType):
            return scalar.TABLE[x.key.lower()](self, base)
        if isinstance(kind, T.NullType):
            return base[x.key]  # inside a lambda: a field of a struct
        raise CypherError(f"no property {x.key} on a value of type {kind.simpleString()}")

    def on_haslabel(self, x: A.HasLabel) -> Column:
        b = self.bound(x.var)
        if isinstance(b, Node):
            return col(b.label).isin(list(x.labels))
        if isinstance(b, Edge):
            return col(b.type).isin(list(x.labels))
        raise CypherError(f"{x.var} has no labels")

    def on_index(self, x: A.Index) -> Column:
        base = self.noted(x.of, self(x.of))
        kind = self.dtype(base)
        if isinstance(kind, T.MapType):
            return F.try_element_at(base, self(x.at))
        if isinstance(kind, T.StructType) and isinstance(x.at, A.Lit):
            return base[x.at.value] if x.at.value in kind.names else F.lit(None)
        if isinstance(x.at, A.Lit) and type(x.at.value) is not int:
            raise CypherError("a list index must be an integer")
        at = self(x.at).cast("int")
        return F.try_element_at(base, F.when(at >= 0, at + 1).otherwise(at))

    def on_slice(self, x: A.Slice) -> Column:
        base = self(x.of)
        n = F.size(base)
        clamp = lambda e, d: d if e is None else (lambda c: F.greatest(F.least(F.when(c < 0, c + n).otherwise(c), n), F.lit(0)))(self(e).cast("int"))
        lo, hi = clamp(x.lo, F.lit(0)), clamp(x.hi, n)
        return F.slice(base, lo + 1, F.greatest(hi - lo, F.lit(0)))

    def on_case(self, x: A.Case) -> Column:
        out = None
        for test, value in x.whens:
            cond = self(test) if x.subject is None else self(A.Op("=", (x.subject, test)))
            out = F.when(cond, self(value)) if out is None else out.when(cond, self(value))
        return out if x.other is None else out.otherwise(self(x.other))

    # ------------------------------------------------------------- lambdas

    def inner(self, kinds: dict | None = None, **local) -> Expr:
        out = Expr(self.df, self.scope, self.params, {**self.local, **local})
        out.typed = {**self.typed, **{k: F.lit(None).cast(t) for k, t in (kinds or {}).items() if not isinstance(t, T.NullType)}}
        return out

    def element(self, x, c: Column) -> T.DataType:
        kind = self.dtype(self.noted(x, c))
        return kind.elementType if isinstance(kind, T.ArrayType) else T.NullType()

    def on_listcomp(self, x: A.ListComp) -> Column:
        out = self(x.of)
        kinds = {x.var: self.element(x.of, out)}
        if x.where is not None:
            out = F.filter(out, lambda v: self.inner(kinds, **{x.var: v})(x.where))
        if x.value is not None:
            out = F.transform(out, lambda v: self.inner(kinds, **{x.var: v})(x.value))
        return out

    def on_quantifier(self, x: A.Quantifier) -> Column:
        of = self(x.of)
        kinds = {x.var: self.element(x.of, of)}
        test = lambda v: self.inner(kinds, **{x.var: v})(x.where)
        if x.kind == "all":
            return F.forall(of, test)
        if x.kind == "any":
            return F.exists(of, test)
        if x.kind == "none":
            return ~F.exists(of, test)
        return F.size(F.filter(of, test)) == 1

    def on_reduce(self, x: A.Reduce) -> Column:
        of, init = self(x.of), self.noted(x.init, self(x.init))
        item, start = self.dtype(self.noted(x.of, of)), self.dtype(init)
        if isinstance(item, T.ArrayType) and isinstance(item.elementType, T.FloatType | T.DoubleType) or isinstance(start, T.FloatType | T.DoubleType):
            if isinstance(start, scalar.NUMERIC):
                init = init.cast("double")
        return F.aggregate(of, init, lambda a, v: (lambda r: r.cast(start) if isinstance(start, INTEGRAL) and not isinstance(item.elementType, T.FloatType | T.DoubleType) else r)(self.inner({x.acc: start, x.var: self.element(x.of, of)}, **{x.acc: a, x.var: v})(x.value)))

    # ----------------------------------------------------------- operators

    def on_op(self, x: A.Op) -> Column:
        op, args = x.op, x.args
        if op in ("AND", "OR", "XOR"):
            a, b = self(args[0]), self(args[1])
            if op == "XOR":
                return (a & ~b) | (~a & b)
            return a & b if op == "AND" else a | b
        if op == "NOT":
            return ~self(args[0])
        if op in ("IS NULL", "IS NOT NULL"):
            c = self.presence(args[0])
            return c.isNull() if op == "IS NULL" else c.isNotNull()
        if op == "IN":
            return self.contained(*args)
        if op in ("+", "-") and (d := self.duration(args[1])) is not None:
            return scalar.shifted(self, self(args[0]), d, 1 if op == "+" else -1)
        if op in ("=", "<>"):
            a, b = self.identity(args[0]), self.identity(args[1])
            if isinstance(args[0], A.ListOf) and not args[0].items or isinstance(args[1], A.ListOf) and not args[1].items:
                a, b = F.size(a), F.size(b)
            return a == b if op == "=" else a != b
        a, b = self.noted(args[0], self(args[0])), self.noted(args[1], self(args[1])) if len(args) > 1 else None
        if op == "NEG":
            return F.lit(0) - a
        if op == "+":
            return self.plus(a, b)
        if op == "-":
            return a - b
        if op == "*":
            return a * b
        if op == "/":
            if self.integral(args[0], a) and self.integral(args[1], b):
                return F.try_divide(a - F.try_mod(a, b), b).cast("long")
            return F.try_divide(a.cast("double"), b)
        if op == "%":
            return F.try_mod(a, b)
        if op == "^":
            return F.pow(a, b)
        if op in ("<", "<=", ">", ">="):
            return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
        if op == "STARTS WITH":
            return F.startswith(a, b)
        if op == "ENDS WITH":
            return F.endswith(a, b)
        if op == "CONTAINS":
            return F.contains(a, b)
        if op == "=~":
            return F.rlike(a, F.concat(F.lit("^(?:"), b, F.lit(")$")))
        raise CypherError(f"unknown operator {op}")

    def duration(self, x):
        if isinstance(x, A.Call) and x.name.lower() == "duration" and x.args and isinstance(x.args[0], A.MapOf):
            return scalar.duration_parts({k: self(v) for k, v in x.args[0].items})
        return None

    def plus(self, a: Column, b: Column) -> Column:
        ka, kb = self.dtype(a), self.dtype(b)
        if isinstance(ka, T.ArrayType) and isinstance(kb, T.ArrayType):
            return F.concat(a, b)
        if isinstance(ka, T.ArrayType):
            return F.concat(a, F.array(b))
        if isinstance(kb, T.ArrayType):
            return F.concat(F.array(a), b)
        if isinstance(ka, T.StringType) or isinstance(kb, T.StringType):
            return F.concat(a.cast("string"), b.cast("string"))
        return a + b

    def presence(self, x) -> Column:
        if isinstance(x, A.Var) and x.name not in self.local:
            return self.identity(x)
        return self(x)

    def identity(self, x) -> Column:
        """A term as it is compared: entities by id (and label)."""
        if isinstance(x, A.Var) and x.name not in self.local:
            b = self.bound(x.name)
            if isinstance(b, Node):
                return col(b.id) if len(b.labels) == 1 else F.when(col(b.id).isNotNull(), F.struct(col(b.label), col(b.id)))
            if isinstance(b, Edge):
                return F.when(col(b.eid).isNotNull(), F.struct(col(b.type), col(b.eid)))
            if isinstance(b, Path):
                return col(b.nodes)
        return self(x)

    def contained(self, item, of) -> Column:
        values = of.items if isinstance(of, A.ListOf) else None
        if isinstance(of, A.Param):
            v = self.params.get(of.name)
            if isinstance(v, list | tuple):
                values = tuple(A.Lit(i) for i in v)
        one = self.identity(item)
        if values is not None:
            if not values:
                return F.lit(False)
            return reduce(lambda p, q: p | q, [one == self.identity(v) for v in values]) if not all(isinstance(v, A.Lit) for v in values) else one.isin([v.value for v in values])
        many = self(of)
        kind = self.dtype(many)
        if isinstance(item, A.Var) and isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and "__id" in kind.elementType.names:
            b = self.scope.get(item.name)
            if isinstance(b, Node):
                return F.array_contains(F.transform(many, lambda v: F.struct(v["__label"], v["__id"])), F.struct(col(b.label), col(b.id)))
        return F.array_contains(many, one)

    # ----------------------------------------------------------- functions

    def on_call(self, x: A.Call) -> Column:
        low = x.name.lower()
        if aggregate.is_aggregate(x.name):
            return self.aggregated(x)
        special = getattr(self, "fn_" + low, None)
        if special is not None:
            got = special(x)
            if got is not None:
                return got
        if aggregate.is_native(x.name):
            return aggregate.native(x.name, [self(a) for a in x.args])
        if low in ("filter", "arrayfilter", "arraymap") and x.args and isinstance(x.args[0], A.Lambda):
            f, of = x.args[0], self(x.args[1])
            kinds = {f.params[0]: self.element(x.args[1], of)}
            run = lambda v: self.inner(kinds, **{f.params[0]: v})(f.body)
            return F.transform(of, run) if low == "arraymap" else F.filter(of, run)
        if low in ("all", "any", "none", "single") and x.args and isinstance(x.args[0], A.Lambda):
            return self.on_quantifier(A.Quantifier(low, x.args[0].params[0], x.args[1], x.args[0].body))
        if low not in scalar.TABLE:
            raise CypherError(f"unknown function {x.name!r}")
        try:
            return scalar.TABLE[low](self, *[self.noted(a, self(a)) for a in x.args])
        except TypeError as e:
            raise CypherError(f"wrong arguments for {x.name}: {e}") from e

    def aggregated(self, x: A.Call) -> Column:
        if aggregate.is_native(x.name):
            return aggregate.native(x.name, [self(a) for a in x.args])
        low = x.name.lower()
        if not x.args:
            raise CypherError(f"{x.name} needs an argument")
        first = self.identity(x.args[0]) if low in ("count", "countif") else self(x.args[0])
        return aggregate.AGGREGATES[low](self, first, x.distinct, *[self(a) for a in x.args[1:]])

    def on_countstar(self, x) -> Column:
        return F.count(F.lit(1))

    def entity(self, x):
        if len(x.args) == 1 and isinstance(x.args[0], A.Var) and x.args[0].name not in self.local:
            return self.bound(x.args[0].name)
        return None

    def fn_exists(self, x):
        return self.presence(x.args[0]).isNotNull()

    def fn_labels(self, x):
        b = self.entity(x)
        return F.when(col(b.id).isNotNull(), F.array(col(b.label))) if isinstance(b, Node) else F.array(self(x.args[0])["__label"])

    def fn_label(self, x):
        b = self.entity(x)
        return col(b.label) if isinstance(b, Node) else self(x.args[0])["__label"]

    def fn_type(self, x):
        b = self.entity(x)
        if isinstance(b, Edge):
            return col(b.type)
        if isinstance(b, Walk):
            return F.get(col(b.rels), F.lit(0))["__type"]
        return self(x.args[0])["__type"]

    def fn_id(self, x):
        b = self.entity(x)
        if isinstance(b, Node):
            return col(b.id)
        if isinstance(b, Edge):
            return col(b.eid)
        return self(x.args[0])["__id"]

    def fn_elementid(self, x):
        b = self.entity(x)
        if isinstance(b, Node):
            return element_id(b)
        if isinstance(b, Edge):
            return F.concat(col(b.type), F.lit(":"), as_text(col(b.src)), F.lit("->"), as_text(col(b.dst)))
        raise CypherError("elementId needs a node or relationship")

    def fn_startnode(self, x):
        b = self.entity(x)
        return F.struct(col(b.src).alias("__id"), col(b.src_label).alias("__label"))

    def fn_endnode(self, x):
        b = self.entity(x)
        return F.struct(col(b.dst).alias("__id"), col(b.dst_label).alias("__label"))

    def fn_properties(self, x):
        b = self.entity(x)
        if isinstance(b, Node | Edge):
            return F.struct(*(col(c).alias(p) for p, c in sorted(b.props.items())))
        return self(x.args[0])

    def fn_keys(self, x):
        b = self.entity(x)
        if isinstance(b, Node | Edge):
            return F.filter(F.array(*(F.when(col(c).isNotNull(), F.lit(p)) for p, c in sorted(b.props.items()))), lambda v: v.isNotNull())
        return None

    def fn_length(self, x):
        b = self.entity(x)
        if isinstance(b, Path):
            return F.when(col(b.nodes).isNotNull(), F.size(col(b.rels)).cast("long"))
        return None

    def fn_nodes(self, x):
        b = self.entity(x)
        if isinstance(b, Path):
            return col(b.nodes)
        raise CypherError("nodes() needs a path")

    def fn_relationships(self, x):
        b = self.entity(x)
        if isinstance(b, Path):
            return col(b.rels)
        raise CypherError("relationships() needs a path")

    fn_rels = fn_edges = fn_relationships

    def fn_cost(self, x):
        b = self.entity(x)
        if isinstance(b, Path) and b.cost:
            return col(b.cost)
        raise CypherError("cost() needs a weighted shortest path")

    def fn_duration(self, x):
        if x.args and isinstance(x.args[0], A.MapOf):
            months, days, us = self.duration(x)
            return F.make_interval(F.lit(0), months, F.lit(0), days, F.lit(0), F.lit(0), us / 1e6)
        return F.to_timestamp(self(x.args[0]))


def has_aggregate(x) -> bool:
    return any(isinstance(n, A.CountStar) or isinstance(n, A.Call) and aggregate.is_aggregate(n.name) for n in A.walk(x))
