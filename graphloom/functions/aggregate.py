"""Aggregates, and native functions called through a prefix."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.native import BY_LOWER, spark_group
from graphloom.plans.ast import CypherError

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def total(ctx, x: Column, distinct: bool) -> Column:
    zero = F.lit(0).cast("long") if isinstance(ctx.dtype(x), INTEGRAL) else F.lit(0.0)
    return F.coalesce(F.sum_distinct(x) if distinct else F.sum(x), zero)


def percentile_disc(ctx, x: Column, distinct: bool, p: Column) -> Column:
    """Of distinct values; all others are made by `ordered_percentile`."""
    held = F.array_sort(F.collect_set(x))
    return F.try_element_at(held, F.greatest(F.lit(1), F.ceil(p * F.size(held))).cast("int"))


def ordered_percentile(name: str, share: float, kind: T.DataType) -> Column:
    """The discrete percentile of a column, which Spark keeps as counts."""
    out = F.expr(f"percentile_disc({float(share)!r}D) WITHIN GROUP (ORDER BY `{name}`)")
    return out.cast(kind) if isinstance(kind, T.NumericType) else out


def spread(f: Callable) -> Callable:
    """A single value has spread 0; none has none."""
    return lambda ctx, x, d: F.when(F.count(x) == 1, F.lit(0.0)).otherwise(f(x))


AGGREGATES: dict[str, Callable] = {
    "count": lambda ctx, x, d: F.count_distinct(x) if d else F.count(x),
    "sum": total,
    "avg": lambda ctx, x, d: F.avg(F.when(F.lit(True), x)) if not d else F.try_divide(F.sum_distinct(x), F.count_distinct(x)),
    "min": lambda ctx, x, d: F.min(x),
    "max": lambda ctx, x, d: F.max(x),
    "collect": lambda ctx, x, d: F.collect_set(x) if d else F.collect_list(x),
    "stdev": spread(F.stddev_samp),
    "stdevp": spread(F.stddev_pop),
    "percentilecont": lambda ctx, x, d, p: F.percentile(x, p),
    "percentiledisc": percentile_disc,
    "anylast": lambda ctx, x, d: F.any_value(x),
    "countif": lambda ctx, x, d: F.count_if(x),
}

#: Names of other engines' aggregates -> Spark, by argument columns.
NATIVE: dict[str, Callable] = {
    "any": F.any_value, "anylast": F.any_value, "first_value": F.first, "last_value": F.last, "uniq": F.approx_count_distinct, "uniqcombined": F.approx_count_distinct, "uniqhll12": F.approx_count_distinct, "uniqexact": F.count_distinct,
    "quantile": lambda x: F.percentile_approx(x, 0.5), "quantileexact": lambda x: F.percentile(x, 0.5), "median": F.median, "grouparray": F.collect_list, "groupuniqarray": F.collect_set, "varpop": F.var_pop, "varsamp": F.var_samp,
    "stddevpop": F.stddev_pop, "stddevsamp": F.stddev_samp, "covarpop": F.covar_pop, "covarsamp": F.covar_samp, "corr": F.corr, "skewpop": F.skewness, "kurtpop": F.kurtosis, "argmin": F.min_by, "argmax": F.max_by, "groupbitand": F.bit_and,
    "groupbitor": F.bit_or, "groupbitxor": F.bit_xor, "groupbitmap": F.count_distinct, "avgweighted": lambda x, w: F.try_divide(F.sum(x * w), F.sum(w)), "countif": F.count_if, "sumif": lambda x, c: F.sum(F.when(c, x)),
    "avgif": lambda x, c: F.avg(F.when(c, x)), "groupconcat": lambda x: F.listagg(x.cast("string"), F.lit(",")), "histogram": lambda x: F.histogram_numeric(x, F.lit(10)), "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count,
    "anyheavy": F.mode, "mode": F.mode, "quantiletdigest": lambda x: F.percentile_approx(x, 0.5), "quantileexactexclusive": lambda x: F.percentile(x, 0.5), "sumkahan": F.sum, "sumwithoverflow": F.sum, "sumdistinct": F.sum_distinct, "countdistinct": F.count_distinct,
    "grouparraysorted": lambda x: F.array_sort(F.collect_list(x)), "simplelinearregression": lambda x, y: F.struct(F.regr_slope(y, x).alias("k"), F.regr_intercept(y, x).alias("b")), "topk": lambda x: F.transform(F.call_function("approx_top_k", x, F.lit(10)), lambda v: v["item"]),
}
PREFIXES = ("ch.", "chagg.", "dbx.", "spark.")


def is_native(name: str) -> bool:
    return name.lower().startswith(PREFIXES)


def is_spark_aggregate(name: str) -> bool:
    return spark_group(name) == "agg_funcs"


def by_condition(low: str) -> Callable | None:
    """An aggregate with `If` behind its name: of the rows where the last
    argument holds."""
    base = NATIVE.get(low.removesuffix("if")) if low.endswith("if") else None
    return None if base is None else lambda *args: base(*(F.when(args[-1], a) for a in args[:-1] or (F.lit(1),)))


def is_native_aggregate(name: str) -> bool:
    prefix, _, f = name.partition(".")
    low = f.lower()
    if prefix.lower() == "chagg":
        return True
    return (low in NATIVE or by_condition(low) is not None) and low not in BY_LOWER if prefix.lower() == "ch" else is_spark_aggregate(low)


def native(name: str, args: list[Column]) -> Column:
    prefix, _, f = name.partition(".")
    if not f:
        raise CypherError(f"{name!r} names no function")
    low, ch = f.lower(), prefix.lower() in ("ch", "chagg")
    try:
        if ch and low in BY_LOWER and prefix.lower() == "ch":
            return BY_LOWER[low](*args)
        if ch and (own := NATIVE.get(low) or by_condition(low)) is not None:
            return own(*args)
    except TypeError as e:
        raise CypherError(f"wrong arguments for {name}: {e}") from e
    if prefix.lower() == "chagg" or spark_group(low) is None:
        raise CypherError(f"function {name!r} has no Spark equivalent here")
    return F.call_function(f, *args)


def is_aggregate(name: str) -> bool:
    return name.lower() in AGGREGATES or is_native(name) and is_native_aggregate(name)
