"""Vector and full-text search over node properties, in columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalar import cosine, distance
from graphloom.plans.ast import CypherError
from graphloom.plans.scope import Node
from graphloom.sources.frames import node_frame

GRAM = 4


def bound(df: DataFrame, label: str) -> tuple[DataFrame, Node]:
    props = {c: f"_p_{c}" for c in df.columns if c not in ("__id", "__label", "score", "__rank")}
    out = df.select(F.col("__id").alias("_p___id"), F.col("__label").alias("_p___label"), *(F.col(f"`{p}`").alias(c) for p, c in props.items()), "score")
    return out, Node("_p___id", "_p___label", (label,), props)


def vector_query(graph, schema, args: list):
    """The k nodes nearest to a vector.  score: cosine similarity, or
    1 / (1 + distance) for euclidean indexes."""
    if len(args) != 3:
        raise CypherError("db.index.vector.queryNodes needs an index, k and a vector")
    name, k, vector = args
    index = next((i for i in schema.vector_indexes if i.name == name), None)
    if index is None:
        raise CypherError(f"unknown vector index {name!r}")
    if index.dimensions and len(vector) != index.dimensions:
        raise CypherError(f"index {name!r} has {index.dimensions} dimensions, the vector {len(vector)}")
    df = node_frame(graph.tables, schema, index.label)
    own, query = F.col(f"`{index.property}`"), F.array(*(F.lit(float(x)) for x in vector))
    if index.similarity.lower().startswith("euclid"):
        score = F.lit(1.0) / (F.lit(1.0) + distance(own, query))
    else:
        score = cosine(own, query)
    found = df.withColumn("score", score).where("score IS NOT NULL").orderBy(F.desc("score"), "__id").limit(int(k))
    return bound(found, index.label)


def gram_set(text: Column) -> Column:
    """Distinct 4-grams of a text in lower case."""
    t = F.lower(text)
    n = F.greatest(F.char_length(t) - (GRAM - 1), F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(t, i, F.lit(GRAM))))


def gram_score(text: Column, query: str) -> Column:
    """Twice the shared 4-grams, over all: 1 for equal texts."""
    q = query.lower()
    own = sorted({q[i : i + GRAM] for i in range(max(len(q) - GRAM + 1, 1))})
    grams = gram_set(text)
    both = F.size(F.array_intersect(grams, F.array(*(F.lit(g) for g in own))))
    return F.lit(2.0) * both / (F.size(grams) + F.lit(len(own)))


def fulltext_query(graph, schema, args: list):
    """Nodes that match a text, best first: 100, as many as the third argument
    says, or all if that is null.  Analyzers: standard (some term occurs, ranked
    by n-gram likeness), ngram (any likeness), exact (each term occurs)."""
    if len(args) < 2:
        raise CypherError("db.index.fulltext.queryNodes needs an index and a text")
    name, text, limit = args[0], str(args[1]), args[2] if len(args) > 2 else 100
    index = next((i for i in schema.fulltext_indexes if i.name == name), None)
    if index is None:
        raise CypherError(f"unknown fulltext index {name!r}")
    df = node_frame(graph.tables, schema, index.label)
    cols = [F.coalesce(F.col(f"`{p}`").cast("string"), F.lit("")) for p in index.properties]
    terms = [t for t in text.lower().split() if t]
    if not terms:
        raise CypherError("the search text is empty")
    some = lambda t: reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lit(t)) for c in cols])
    likeness = [gram_score(c, text) for c in cols]
    score = likeness[0] if len(likeness) == 1 else F.greatest(*likeness)
    if index.analyzer == "exact":
        tokens = [F.split(F.lower(c), r"[^\p{L}\p{N}]+") for c in cols]
        match = reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [F.array_contains(t, w) for t in tokens]) for w in terms])
        found = df.where(match).withColumn("score", F.lit(1.0))
    elif index.analyzer == "ngram":
        found = df.withColumn("score", score).where("score > 0")
    else:
        found = df.where(reduce(lambda a, b: a | b, [some(t) for t in terms])).withColumn("score", score)
    found = found.orderBy(F.desc("score"), "__id")
    return bound(found if limit is None else found.limit(int(limit)), index.label)
