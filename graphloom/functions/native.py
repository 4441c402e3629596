"""Scalar functions of the `ch.` prefix, by the names that users know.

The names are fixed values; what each does is told by its Spark expression.
Names that are not here go to Spark under their own name, if it has them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def trunc(unit: str) -> Callable:
    return lambda x: F.date_trunc(unit, x)


def case(*args: Column) -> Column:
    """condition, value, condition, value, ..., else."""
    out = F.when(args[0], args[1])
    for i in range(2, len(args) - 1, 2):
        out = out.when(args[i], args[i + 1])
    return out.otherwise(args[-1])


def array_sum(x: Column) -> Column:
    return F.aggregate(F.transform(x, lambda v: v.cast("double")), F.lit(0.0), lambda s, v: s + v)


def json_value(x: Column, k: Column) -> Column:
    return F.call_function("get_json_object", x, F.concat(F.lit("$."), k))


def json_part(kind: str) -> Callable:
    return lambda x, k: json_value(x, k).try_cast(kind)


SCALARS: dict[str, Callable] = {
    # dates
    "toStartOfYear": trunc("year"), "toStartOfQuarter": trunc("quarter"), "toStartOfMonth": trunc("month"), "toStartOfWeek": trunc("week"), "toMonday": trunc("week"), "toStartOfDay": trunc("day"), "toStartOfHour": trunc("hour"), "toStartOfMinute": trunc("minute"),
    "toYear": F.year, "toQuarter": F.quarter, "toMonth": F.month, "toDayOfMonth": F.dayofmonth, "toDayOfYear": F.dayofyear, "toDayOfWeek": lambda x: F.weekday(x) + 1, "toHour": F.hour, "toMinute": F.minute, "toSecond": F.second,
    "toYYYYMM": lambda x: F.year(x) * 100 + F.month(x), "toYYYYMMDD": lambda x: F.year(x) * 10000 + F.month(x) * 100 + F.dayofmonth(x), "toUnixTimestamp": lambda x: F.unix_timestamp(x.cast("timestamp")), "fromUnixTimestamp": F.timestamp_seconds,
    "toDate": F.to_date, "toDateTime": F.to_timestamp, "now": F.current_timestamp, "today": F.current_date, "yesterday": lambda: F.date_sub(F.current_date(), 1), "addDays": lambda x, n: F.date_add(x, n.cast("int")), "subtractDays": lambda x, n: F.date_sub(x, n.cast("int")), "addMonths": lambda x, n: F.add_months(x, n.cast("int")),
    # text
    "length": F.octet_length, "lengthUTF8": F.char_length, "lowerUTF8": F.lower, "upperUTF8": F.upper, "reverseUTF8": F.reverse, "trimBoth": F.trim, "trimLeft": F.ltrim, "trimRight": F.rtrim, "position": lambda s, x: F.locate(x, s) if isinstance(x, str) else F.call_function("locate", x, s),
    "replaceAll": F.replace, "replaceRegexpAll": F.regexp_replace, "match": F.rlike, "splitByChar": lambda d, s: F.split(s, F.concat(F.lit("\\Q"), d, F.lit("\\E"))), "splitByString": lambda d, s: F.split(s, F.concat(F.lit("\\Q"), d, F.lit("\\E"))), "base64Encode": lambda x: F.base64(x.cast("binary")), "base64Decode": lambda x: F.unbase64(x).cast("string"),
    # arrays
    "arrayElement": lambda x, i: F.try_element_at(x, i.cast("int")), "arrayDistinct": F.array_distinct, "arraySort": F.array_sort, "arrayReverse": F.reverse, "arrayConcat": F.concat, "arraySum": array_sum, "arrayMin": F.array_min, "arrayMax": F.array_max, "arrayAvg": lambda x: F.try_divide(array_sum(x), F.size(x)),
    "arrayUniq": lambda x: F.size(F.array_distinct(x)), "arrayIntersect": F.array_intersect, "has": F.array_contains, "hasAny": F.arrays_overlap, "hasAll": lambda x, y: F.size(F.array_except(y, x)) == 0, "indexOf": F.array_position, "arrayStringConcat": lambda x, d: F.array_join(x, d) if isinstance(d, str) else F.call_function("array_join", x, d),
    "empty": lambda x: F.coalesce(F.length(x.cast("string")), F.lit(0)) == 0, "notEmpty": lambda x: F.coalesce(F.length(x.cast("string")), F.lit(0)) > 0,
    # conditions, casts and numbers
    "if": lambda c, a, b: F.when(c, a).otherwise(b), "multiIf": case, "ifNull": F.coalesce, "isNull": F.isnull, "isNotNull": F.isnotnull, "toString": lambda x: x.cast("string"), "toInt64": lambda x: x.cast("long"), "toInt32": lambda x: x.cast("int"), "toFloat64": lambda x: x.cast("double"),
    "toInt64OrNull": lambda x: x.try_cast("long"), "toFloat64OrNull": lambda x: x.try_cast("double"), "toInt64OrZero": lambda x: F.coalesce(x.try_cast("long"), F.lit(0).cast("long")), "toFloat64OrZero": lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0)),
    "intDiv": lambda a, b: F.call_function("div", a, b), "modulo": lambda a, b: a % b, "plus": lambda a, b: a + b, "minus": lambda a, b: a - b, "multiply": lambda a, b: a * b, "divide": lambda a, b: F.try_divide(a.cast("double"), b.cast("double")),
    # JSON texts
    "JSONExtractString": json_part("string"), "JSONExtractInt": json_part("long"), "JSONExtractFloat": json_part("double"), "JSONExtractBool": json_part("boolean"), "JSONHas": lambda x, k: json_value(x, k).isNotNull(),
}
BY_LOWER = {k.lower(): f for k, f in SCALARS.items()}


@cache
def spark_group(name: str) -> str | None:
    """The group that Spark's own registry has a function in, if it has it."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return None
    ident = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name)
    found = spark._jsparkSession.sessionState().functionRegistry().lookupFunction(ident)
    return (found.get().getGroup() or "other") if found.isDefined() else None
