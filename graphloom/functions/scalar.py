"""Scalar and list functions as Spark columns, independent of ANSI mode.

Each entry takes a context (for types) and argument columns.  Lookup ignores
case.  Where semantics differ from Spark's builtin of that name (0-based
substring, literal split, floor-half-up rounding, empty ranges, lenient
conversions, weekday numbers), the entry says it in columns.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.plans.ast import CypherError

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMERIC = (*INTEGRAL, T.FloatType, T.DoubleType, T.DecimalType)
TABLE: dict[str, Callable] = {}


def register(*names: str):
    def add(f):
        for n in names:
            TABLE[n.lower()] = f
        return f

    return add


def plain(name: str, f: Callable) -> None:
    TABLE[name.lower()] = lambda ctx, *a: f(*a)


def text(c: Column) -> Column:
    return c.cast("string")


for _name, _f in {
    "toUpper": F.upper, "upper": F.upper, "toLower": F.lower, "lower": F.lower, "trim": F.trim, "lTrim": F.ltrim, "rTrim": F.rtrim, "abs": F.abs, "sqrt": F.sqrt, "sign": F.signum, "sin": F.sin, "cos": F.cos, "tan": F.tan,
    "asin": F.asin, "acos": F.acos, "atan": F.atan, "atan2": F.atan2, "exp": F.exp, "log": F.ln, "ln": F.ln, "log10": F.log10, "cot": F.cot, "degrees": F.degrees, "radians": F.radians, "pow": F.pow, "coalesce": F.coalesce,
    "nullIf": F.nullif, "startsWith": F.startswith, "endsWith": F.endswith, "contains": F.contains, "rand": lambda: F.rand(), "randomUUID": lambda: F.uuid(), "pi": lambda: F.pi(), "e": lambda: F.e(), "reverse": F.reverse, "tuple": F.struct,
    "ceil": lambda x: F.ceil(x).cast("double"), "floor": lambda x: F.floor(x).cast("double"), "head": lambda x: F.get(x, F.lit(0)), "last": lambda x: F.try_element_at(x, F.lit(-1)), "tail": lambda x: F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))),
    "localdatetime": lambda *a: F.to_timestamp_ntz(*a) if a else F.localtimestamp(), "localtime": lambda: F.date_format(F.localtimestamp(), "HH:mm:ss.SSS"), "isNaN": F.isnan, "char_length": F.char_length, "character_length": F.char_length,
}.items():
    plain(_name, _f)


@register("round")
def round_(ctx, x, digits=None):
    if digits is None:
        return F.floor(x + F.lit(0.5)).cast("double")
    n = ctx.constant(digits)
    return F.floor(x + F.lit(0.5)).cast("double") if n == 0 else F.round(x.cast("double"), int(n))


@register("replace")
def replace(ctx, s, a, b):
    return F.replace(s, a, b)


@register("substring")
def substring(ctx, s, start, n=None):
    at = start.cast("int") + 1
    return F.substr(s, at) if n is None else F.substr(s, at, n.cast("int"))


@register("left")
def left(ctx, s, n):
    return F.left(s, n)


@register("right")
def right(ctx, s, n):
    return F.right(s, n)


@register("size")
def size(ctx, x):
    kind = ctx.dtype(x)
    if isinstance(kind, T.ArrayType | T.MapType):
        return F.when(x.isNotNull(), F.size(x).cast("long"))
    return F.char_length(x).cast("long")


@register("length")
def length(ctx, x):
    return size(ctx, x)


@register("split")
def split(ctx, s, d):
    return F.split(s, F.concat(F.lit("\\Q"), d, F.lit("\\E")))


@register("isEmpty")
def is_empty(ctx, x):
    return size(ctx, x) == 0


@register("range")
def range_(ctx, lo, hi, step=None):
    step = F.lit(1).cast("long") if step is None else step.cast("long")
    lo, hi = lo.cast("long"), hi.cast("long")
    fits = ((step > 0) & (lo <= hi)) | ((step < 0) & (lo >= hi))
    safe_step = F.when(fits, step).otherwise(F.lit(1))
    return F.when(fits, F.sequence(lo, F.when(fits, hi).otherwise(lo), safe_step)).otherwise(F.array().cast("array<bigint>"))


@register("toInteger", "toInt", "toIntegerOrNull")
def to_integer(ctx, x):
    kind = ctx.dtype(x)
    if isinstance(kind, T.BooleanType):
        return x.cast("long")
    if isinstance(kind, T.StringType):
        return F.coalesce(x.try_cast("long"), F.expr("1").cast("long") * x.try_cast("double").try_cast("long"))
    return x.try_cast("double").try_cast("long") if isinstance(kind, T.FloatType | T.DoubleType) else x.try_cast("long")


@register("toFloat", "toFloatOrNull")
def to_float(ctx, x):
    return x.try_cast("double")


@register("toString", "toStringOrNull")
def to_string(ctx, x):
    return text(x)


@register("toBoolean", "toBooleanOrNull")
def to_boolean(ctx, x):
    return x.try_cast("boolean")


@register("keys")
def keys(ctx, x):
    kind = ctx.dtype(x)
    if isinstance(kind, T.StructType):
        return F.when(x.isNotNull(), F.array(*(F.lit(f.name) for f in kind.fields)))
    return F.map_keys(x)


@register("normalize")
def normalize(ctx, x, form=None):
    kind = "NFC" if form is None else str(ctx.constant(form))

    @F.pandas_udf("string")
    def run(s):
        return s.map(lambda t: None if t is None else unicodedata.normalize(kind, t))

    return run(x)


VALUE_TYPES = [(T.BooleanType, "BOOLEAN"), (INTEGRAL, "INTEGER"), ((T.FloatType, T.DoubleType, T.DecimalType), "FLOAT"), (T.StringType, "STRING"), (T.DateType, "DATE"), (T.TimestampType, "ZONED DATETIME"), (T.TimestampNTZType, "LOCAL DATETIME"), (T.ArrayType, "LIST"), ((T.StructType, T.MapType), "MAP")]


@register("valueType")
def value_type(ctx, x):
    kind = ctx.dtype(x)
    name = next((n for k, n in VALUE_TYPES if isinstance(kind, k)), "NULL")
    return F.when(x.isNull(), F.lit("NULL")).otherwise(F.lit(name))


# ------------------------------------------------------------------ vectors


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), norm))


def distance(a: Column, b: Column) -> Column:
    parts = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.when(F.size(a) == F.size(b), F.sqrt(F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)))


plain("gds.similarity.cosine", cosine)
plain("vector.similarity.cosine", cosine)
plain("gds.similarity.euclidean", lambda a, b: F.lit(1.0) / (F.lit(1.0) + distance(a, b)))
plain("vector.similarity.euclidean", lambda a, b: F.lit(1.0) / (F.lit(1.0) + distance(a, b)))
plain("gds.similarity.euclideanDistance", distance)


# ----------------------------------------------------------------- temporal


def moment(ctx, x: Column) -> Column:
    """A date or timestamp: whole numbers are milliseconds since the epoch."""
    kind = ctx.dtype(x)
    if isinstance(kind, INTEGRAL):
        return F.timestamp_millis(x.cast("long"))
    if isinstance(kind, T.StringType):
        return F.to_timestamp(x)
    return x


@register("datetime", "localdatetime.parse")
def datetime_(ctx, x=None):
    if x is None:
        return F.current_timestamp()
    kind = ctx.dtype(x)
    if isinstance(kind, T.StructType):
        names = {f.name for f in kind.fields}
        if "epochMillis" in names:
            return F.timestamp_millis(x["epochMillis"].cast("long"))
        if "epochSeconds" in names:
            return F.timestamp_seconds(x["epochSeconds"].cast("long"))
        part = lambda n, d: x[n] if n in names else F.lit(d)
        return F.make_timestamp(part("year", 1970), part("month", 1), part("day", 1), part("hour", 0), part("minute", 0), part("second", 0))
    return moment(ctx, x)


@register("date")
def date_(ctx, x=None):
    if x is None:
        return F.current_date()
    kind = ctx.dtype(x)
    if isinstance(kind, T.StructType):
        names = {f.name for f in kind.fields}
        part = lambda n: x[n] if n in names else F.lit(1)
        return F.make_date(part("year"), part("month"), part("day"))
    return F.to_date(moment(ctx, x))


@register("time")
def time_(ctx, x=None):
    return F.date_format(F.current_timestamp() if x is None else moment(ctx, x), "HH:mm:ss.SSS")


@register("timestamp")
def timestamp(ctx, x=None):
    return F.unix_timestamp(F.current_timestamp() if x is None else moment(ctx, x))


@register("toUnixTimestampMillis")
def unix_millis(ctx, x):
    return F.unix_millis(moment(ctx, x).cast("timestamp"))


PARTS = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "dayOfWeek": lambda x: F.weekday(x) + 1, "dayOfYear": F.dayofyear, "quarter": F.quarter, "week": F.weekofyear, "epochMillis": lambda x: F.unix_millis(x.cast("timestamp")), "epochSeconds": F.unix_timestamp}
for _name, _f in PARTS.items():
    TABLE[_name.lower()] = lambda ctx, x, f=_f: f(moment(ctx, x)).cast("long")

UNITS = {"year": ("months", 12), "quarter": ("months", 3), "month": ("months", 1), "week": ("days", 7), "day": ("days", 1), "hour": ("us", 3_600_000_000), "minute": ("us", 60_000_000), "second": ("us", 1_000_000), "millisecond": ("us", 1000), "microsecond": ("us", 1), "nanosecond": ("us", 0.001)}


def duration_parts(items: dict) -> tuple[Column, Column, Column]:
    """Months, days and microseconds of duration({...}) arguments."""
    sums = {"months": F.lit(0), "days": F.lit(0), "us": F.lit(0)}
    for name, value in items.items():
        unit = name.lower().rstrip("s")
        if unit not in UNITS:
            raise CypherError(f"unknown duration unit {name!r}")
        kind, times = UNITS[unit]
        sums[kind] = sums[kind] + value * times
    return sums["months"].cast("int"), sums["days"].cast("int"), sums["us"].cast("double")


def shifted(ctx, x: Column, parts: tuple, sign: int) -> Column:
    months, days, us = parts
    kind = ctx.dtype(x)
    out = x
    if isinstance(kind, T.DateType):
        return F.date_add(F.add_months(out, months * sign), days * sign)
    out = moment(ctx, x)
    step = F.make_interval(F.lit(0), months * sign, F.lit(0), days * sign, F.lit(0), F.lit(0), (us * sign / 1e6))
    return F.try_add(out, step)


@register("duration.between")
def between(ctx, a, b):
    return F.unix_millis(moment(ctx, b)) - F.unix_millis(moment(ctx, a))
