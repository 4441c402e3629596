"""Walks of bounded length, shortest paths and weighted shortest paths.

An oriented edge frame has __a and __b (near and far end), __a_label and
__b_label, __eid and __rel (the relationship as a struct).  Frontiers are
keyed by label and id, as ids of different labels overlap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from graphloom.sources.storage import stored

#: A bounded walk is one lazy plan up to this many hops; longer ones are
#: written every so many hops, which keeps plans and lineage short.
LAZY_HOPS = 8


def point(label: str, ident: str):
    return F.struct(F.col(label).alias("__label"), F.col(ident).cast("string").alias("__id"))


def first_level(starts: DataFrame, edges: DataFrame) -> DataFrame:
    none = edges.schema["__rel"].dataType.simpleString()
    return starts.select(
        "__start", "__start_label", F.col("__start").alias("__end"), F.col("__start_label").alias("__end_label"), F.array().cast("array<string>").alias("__eids"), F.array().cast(f"array<{none}>").alias("__rels"), F.array(point("__start_label", "__start")).alias("__nodes"), F.lit(0).alias("__hops"),
    )


def one_more(level: DataFrame, edges: DataFrame) -> DataFrame:
    near = (F.col("__end") == F.col("__a")) & (F.col("__end_label").eqNullSafe(F.col("__a_label")) | F.col("__a_label").isNull())
    return level.join(edges, near).select(
        "__start", "__start_label", F.col("__b").alias("__end"), F.col("__b_label").alias("__end_label"), F.col("__eids").alias("__before"), F.col("__eid").alias("__own"),
        F.concat("__eids", F.array("__eid")).alias("__eids"), F.concat("__rels", F.array("__rel")).alias("__rels"), F.col("__nodes").alias("__passed"), F.concat("__nodes", F.array(point("__b_label", "__b"))).alias("__nodes"), (F.col("__hops") + 1).alias("__hops"),
    )


KEPT = ["__start", "__start_label", "__end", "__end_label", "__eids", "__rels", "__nodes", "__hops"]


def walks(starts: DataFrame, edges: DataFrame, least: int, most: int) -> DataFrame:
    """All trails (no edge twice) of least to most hops from distinct starts."""
    level = first_level(starts, edges)
    out = [level] if least == 0 else []
    for h in range(1, most + 1):
        level = one_more(level, edges).where(~F.array_contains("__before", F.col("__own"))).select(KEPT)
        if h % LAZY_HOPS == 0 and h < most:
            level = stored(level, "walk")
        if h >= least:
            out.append(level)
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result


PAIR = ["__start", "__start_label", "__end", "__end_label"]


def shortest(starts: DataFrame, edges: DataFrame, least: int, most: int, every: bool, goals: DataFrame | None = None, light: bool = False) -> DataFrame:
    """Breadth-first: one shortest path, or all, for each start and end.

    A round keeps only ends that the start has not reached before; state is
    one row a reached pair, not a row a path, and each round writes only its
    own.  Rounds end with the frontier, or when every start has reached all
    goals (__start, __start_label of the ends asked for).  light: paths hold
    as many empty relationships as they have hops, and nothing is carried.
    """
    # each round reads the edges again, so what made them is not done again
    edges = edges.select("__a", "__a_label", "__b", "__b_label", *(() if light else ("__eid", "__rel")))
    rel = None if light else edges.schema["__rel"].dataType.simpleString()
    edges = stored(edges.distinct() if light else edges, "edges")
    if goals is not None:
        starts = stored(starts, "starts")
        goals = stored(goals.select(F.col("__start").alias("__end"), F.col("__start_label").alias("__end_label")).distinct(), "goals")
        reached = lambda rows, how: rows.alias("n").join(goals.withColumn("hit", F.lit(1)).alias("g"), (F.col("n.__end") == F.col("g.__end")) & (F.col("n.__end_label").isNull() | F.col("n.__end_label").eqNullSafe(F.col("g.__end_label"))), how)
        wanted = starts.count() * goals.count()
        there = reached(starts.select(F.col("__start").alias("__end"), F.col("__start_label").alias("__end_label")), "left_semi").count()
    if light:
        level = starts.select("__start", "__start_label", F.col("__start").alias("__end"), F.col("__start_label").alias("__end_label"), F.lit(0).alias("__hops"))
    else:
        level = first_level(starts, edges)
    levels, before = [level], None
    for h in range(1, most + 1):
        if light:
            near = (F.col("__end") == F.col("__a")) & (F.col("__end_label").eqNullSafe(F.col("__a_label")) | F.col("__a_label").isNull())
            step = level.join(edges, near).select("__start", "__start_label", F.col("__b").alias("__end"), F.col("__b_label").alias("__end_label")).distinct().withColumn("__hops", F.lit(h))
        else:
            step = one_more(level, edges).select(KEPT)
        before = level.select(PAIR) if before is None else before.unionByName(level.select(PAIR))
        same = [F.col(f"n.{c}").eqNullSafe(F.col(f"r.{c}")) for c in PAIR]
        step = step.alias("n").join(before.alias("r"), same, "left_anti")
        if not every and not light:
            step = step.groupBy(*PAIR).agg(F.min(F.struct("__eids", "__rels", "__nodes", "__hops")).alias("m")).select(*PAIR, "m.*").select(KEPT)
        # rows are counted as they are written
        seen, counts = Observation(), [F.count(F.lit(1)).alias("n")]
        if goals is not None and not every:
            step, counts = reached(step, "left").select("n.*", "hit"), [*counts, F.count("hit").alias("hits")]
        step = step.observe(seen, *counts)
        level = stored(step.drop("hit"), "bfs")
        if not seen.get["n"]:
            break
        if goals is not None:
            there += reached(level.select(PAIR).distinct(), "left_semi").count() if every else seen.get["hits"]
        levels.append(level)
        if goals is not None and there >= wanted:
            break
    kept = [x for i, x in enumerate(levels) if i >= least] or [level.where("false")]
    result = kept[0]
    for x in kept[1:]:
        result = result.unionByName(x)
    if goals is not None:
        result = reached(result, "left_semi")
    if light:
        kind = "array<struct<__type:string,__eid:string,__src:string,__dst:string>>"
        empty = F.struct(*(F.lit(None).cast("string").alias(c) for c in ("__type", "__eid", "__src", "__dst")))
        return result.select(*PAIR, F.array().cast("array<string>").alias("__eids"), F.array_repeat(empty, F.col("__hops")).cast(kind).alias("__rels"), F.array(point("__start_label", "__start"), point("__end_label", "__end")).alias("__nodes"), "__hops")
    assert rel is not None
    return result.select(KEPT)


def weighted_all(edges: DataFrame, starts: DataFrame, most: int | None = None, fewest_hops: bool = False) -> DataFrame:
    """(__start, node, cost, path): cheapest paths from each start over
    (source, target, weight) rows, by Bellman-Ford rounds until nothing gets
    cheaper.  With fewest_hops only paths of the fewest hops compete.  It is an
    error if costs still fall after `most` rounds, or, without it, after as
    many as there are nodes (a cycle of negative weight)."""
    e = edges.select(F.col("source").alias("s"), F.col("target").alias("t"), F.col("weight").cast("double").alias("w"))
    best = stored(starts.select("__start", F.col("__start").alias("node"), F.lit(0.0).alias("cost"), F.array("__start").alias("path")), "cost")
    front = best
    if most is None:
        most = e.select("s").union(e.select("t")).distinct().count() + 1
    for _ in range(most):
        step = front.join(e, F.col("node") == F.col("s")).select("__start", F.col("t").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), F.concat("path", F.array("t")).alias("path"))
        step = step.groupBy("__start", "node").agg(F.min(F.struct("cost", "path")).alias("m")).select("__start", "node", "m.cost", "m.path")
        old = best.select("__start", "node", F.col("cost").alias("was"))
        better = step.join(old, ["__start", "node"], "left").where("was IS NULL" if fewest_hops else "was IS NULL OR cost < was").drop("was")
        front = stored(better, "cost")
        if front.isEmpty():
            break
        best = stored(best.join(front.select("__start", "node"), ["__start", "node"], "left_anti").unionByName(front), "cost")
    else:
        raise RuntimeError("path costs did not settle")
    return best


def weighted_shortest(edges: DataFrame, source, target=None, most: int | None = None, fewest_hops: bool = False) -> DataFrame:
    """node, cost, path: cheapest paths from one source."""
    kind = edges.schema["source"].dataType
    starts = edges.sparkSession.range(1).select(F.lit(source).cast(kind).alias("__start"))
    best = weighted_all(edges, starts, most, fewest_hops).select("node", "cost", "path")
    return best if target is None else best.where(F.col("node") == F.lit(target))


def with_properties(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Walks whose node structs hold the nodes' properties as well.  nodes:
    __id, __label and properties.  A walk is known by its start and edges."""
    ids = ["__start", "__start_label", "__end", "__end_label", "__eids"]
    props = [c for c in nodes.columns if c not in ("__id", "__label")]
    every = found.select(*ids, F.posexplode("__nodes").alias("pos", "n"))
    own = nodes.select(F.col("__id").cast("string").alias("nid"), F.col("__label").alias("nlabel"), *(F.col(f"`{p}`") for p in props))
    full = every.join(own, (F.col("n.__id") == F.col("nid")) & (F.col("n.__label").isNull() | (F.col("n.__label") == F.col("nlabel"))), "left")
    node = F.struct(F.coalesce("n.__label", "nlabel").alias("__label"), F.col("n.__id").alias("__id"), *(F.col(f"`{p}`") for p in props))
    lists = full.groupBy(*ids).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", node.alias("n")))), lambda x: x["n"]).alias("__full"))
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"l.{c}")) for c in ids]
    return found.alias("f").join(lists.alias("l"), same).select(*(F.col(f"f.{c}") for c in found.columns if c != "__nodes"), F.col("l.__full").alias("__nodes"))


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 10, damping: float = 0.85) -> DataFrame:
    """(node_id, label, pagerank): synchronous rounds from 1 / N, as (1 - d) +
    d * sum(rank / outdegree); nodes without in-edges drop out after round 1.
    nodes: __id, __label; edges: __src, __src_label, __dst, __dst_label.  A node
    is its label and id, as ids of different labels overlap."""
    ends = ["__src", "__src_label", "__dst", "__dst_label"]
    out_degree = edges.groupBy("__src", "__src_label").agg(F.count("*").alias("deg"))
    links = stored(edges.join(out_degree, ["__src", "__src_label"]).groupBy(*ends, "deg").agg(F.count("*").alias("n")), "links")
    n = nodes.count()
    rank = nodes.select(F.col("__id").alias("__src"), F.col("__label").alias("__src_label"), F.lit(1.0 / max(n, 1)).alias("rank"))
    for i in range(iterations):
        share = links.join(rank, ["__src", "__src_label"]).groupBy("__dst", "__dst_label").agg(F.sum(F.col("rank") * F.col("n") / F.col("deg")).alias("r"))
        rank = share.select(F.col("__dst").alias("__src"), F.col("__dst_label").alias("__src_label"), (F.lit(1 - damping) + F.lit(damping) * F.col("r")).alias("rank"))
        if i % 3 == 2 and i + 1 < iterations:
            rank = stored(rank, "rank")
    return rank.select(F.col("__src").alias("node_id"), F.col("__src_label").alias("label"), F.col("rank").alias("pagerank")).orderBy(F.desc("pagerank"), "node_id", "label")
