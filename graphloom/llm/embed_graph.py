"""Operator 1: embedding near-dedup on robust-pruned flat graphs.

Vectors are unit vectors in double precision; equal vectors of a label are one
node first, so copies, however many, are counted once.  A label's nodes are
cut into overlapping shards around a few centroids (each node belongs to its
nearest one and to every one that may be the nearest of a node in range).  A
shard's flat graph is built by insertion: batches of nodes, each batch at most
as large as the graph, are searched in it greedily from the medoid, and what the
search meets is robust-pruned to a node's links, which are linked back; a second
pass over all nodes does the same with a wider prune, and finds what a node's
own batch kept from it.  The adjacency lists of a node's shards are united.
Then every node is searched in its own shard's graph: greedily from the medoid,
and from itself, to the nearest nodes, and on through all nodes in range.
Similarities are computed exactly, so no link is below the threshold.

`recall` audits what is found against brute force over a bounded sample of the
nodes; with `audit` the result is checked so, and a recall below is an error.

A shard of more than `BLOCK` nodes becomes several graphs, each searched for
all of the shard's nodes, so that any shard is handled in bounded memory.
Links do not leave a task pair by pair: each node gives its count and one edge
to the root of its local component.

Edge cases: null or zero vectors, those with null or non-finite components and
those without a label link with nothing; only equal labels and lengths are
compared; repeated rows of a vec_id are one vector in the counts and give
equal rows (null vec_ids link with nothing); extra columns do not matter; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import components, mix, renewed, stored

#: Nodes of a shard (aimed at) and of a graph (at most, on average).
SHARD, BLOCK, MOST_CENTROIDS = 8192, 8192, 4096
#: Vectors that a centroid is learnt from.
SAMPLE = 16
#: Of the build: links of a node, and with those back to it; what a search keeps,
#: and looks at in a step; nodes inserted at a time.
DEGREE, ROOM, WIDTH, STEP, BATCH = 24, 48, 40, 4, 512
#: Vectors that an audit asks about.
ASKED = 1000
BACK, ALPHA, BEAM, SLACK = 6, 1.2, 8, 0.02


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, dim, v, hash): usable vectors, as bytes of doubles."""
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())

    def run(batches):
        for b in batches:
            ids, labels, dims, out, keys = [], [], [], [], []
            for i, label, e in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if any(x is None for x in e):
                    continue
                x = np.asarray(e, dtype=float)
                top = np.abs(x).max() if len(x) else 0.0
                if not (0 < top < np.inf):
                    continue
                x = x / top
                x = x / np.sqrt((x * x).sum())
                ids.append(i)
                labels.append(label)
                dims.append(len(x))
                out.append(x.tobytes())
                keys.append(hashlib.md5(out[-1]).digest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(dims, pa.int32()), pa.array(out, pa.binary()), pa.array(keys, pa.binary())], ["vec_id", "label", "dim", "v", "hash"])

    own = good.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    return own.mapInArrow(run, "vec_id long, label string, dim int, v binary, hash binary")


def matrix(values) -> np.ndarray:
    values = list(values)
    return np.frombuffer(b"".join(values)).reshape(len(values), -1)


def centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spaced rows."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        for j in range(k):
            if (near == j).any():
                m = x[near == j].mean(0)
                c[j] = m / max(np.sqrt((m * m).sum()), 1e-12)
    return c


def near_shards(x: np.ndarray, c: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row of x, and, as a mask, all centroids
    that may be the nearest of a vector of similarity `least` or more to it.

    Such a vector is at most r away.  If centroid j is its nearest, the row's
    similarity to any centroid i is at most r * |c_i - c_j| above that to j;
    this is asked for each row's few nearest i."""
    s, r = x @ c.T, np.sqrt(max(2 - 2 * least, 0))
    best = np.argsort(-s, axis=1, kind="stable")[:, :4]
    norms, fine = (c * c).sum(1), np.ones(s.shape, dtype=bool)
    for i in best.T:
        apart = np.sqrt(np.maximum(norms[i][:, None] + norms - 2 * c[i] @ c.T, 0))
        fine &= s[np.arange(len(x)), i][:, None] - s <= r * apart + 1e-6
    return best[:, 0], fine


def sharded(nodes: DataFrame, least: float) -> DataFrame:
    """nodes with shard and own (whether it is the node's nearest shard)."""
    counts = nodes.groupBy("label", "dim").count().where(F.col("count") > SHARD).orderBy(F.desc("count"), "label", "dim").limit(MOST_CENTROIDS // 2).collect()
    wanted = {(r.label, r.dim): -(-r["count"] // SHARD) for r in counts}
    scale = max(1.0, sum(wanted.values()) / MOST_CENTROIDS)
    wanted = {key: max(2, int(k / scale)) for key, k in wanted.items()}
    table, learnt = {}, {}
    if wanted:
        # a sample by hash, of all these labels in one job: SAMPLE a centroid
        share = [(r.label, r.dim, min(1.0, SAMPLE * wanted[r.label, r.dim] / r["count"])) for r in counts]
        of = F.broadcast(nodes.sparkSession.createDataFrame(share, "label string, dim int, share double"))
        mark = F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(1 << 30))
        for r in nodes.join(of, ["label", "dim"]).where(mark < F.col("share") * (1 << 30)).select("label", "dim", mark.alias("mark"), "rep", "v").collect():
            learnt.setdefault((r.label, r.dim), []).append((r.mark, r.rep, bytes(r.v)))
    for key, rows in learnt.items():
        table[key] = centroids(matrix(v for _, _, v in sorted(rows)), min(wanted[key], len(rows)))
    sent = nodes.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for b in batches:
            labels, dims = b.column(1).to_pylist(), b.column(2).to_pylist()
            rows, shards, own = [], [], []
            by_key: dict = {}
            for i, key in enumerate(zip(labels, dims, strict=True)):
                by_key.setdefault(key, []).append(i)
            for key, places in by_key.items():
                c = sent.value.get(key)
                if c is None:
                    rows += places
                    shards += [0] * len(places)
                    own += [True] * len(places)
                    continue
                for lo in range(0, len(places), 256):
                    part = np.array(places[lo : lo + 256])
                    nearest, fine = near_shards(matrix(b.column(3)[i].as_py() for i in part.tolist()), c, least)
                    fine[np.arange(len(part)), nearest] = True
                    at, shard = np.nonzero(fine)
                    rows += part[at].tolist()
                    shards += shard.tolist()
                    own += (nearest[at] == shard).tolist()
            out = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(shards, pa.int32()), pa.array(own, pa.bool_())], [*out.schema.names, "shard", "own"])

    return nodes.select("rep", "label", "dim", "v", "n").mapInArrow(run, "rep long, label string, dim int, v binary, n long, shard int, own boolean")


def searched(x: np.ndarray, near: np.ndarray, medoid: int, q: np.ndarray) -> np.ndarray:
    """Greedy search from the medoid for all rows of q side by side: the WIDTH
    nearest nodes that each meets, -1 where there are fewer."""
    n = len(q)
    beam, sims = np.full((n, WIDTH), -1), np.full((n, WIDTH), -np.inf, dtype=np.float32)
    beam[:, 0], sims[:, 0] = medoid, q @ x[medoid]
    fresh = np.zeros((n, WIDTH), dtype=bool)
    fresh[:, 0] = True
    live = np.arange(n)
    while len(live):
        s = np.where(fresh[live], sims[live], -np.inf)
        top = np.argpartition(-s, STEP, axis=1)[:, :STEP]
        good = np.take_along_axis(s, top, 1) > -np.inf
        some = good.any(axis=1)
        live, top, good = live[some], top[some], good[some]
        if not len(live):
            break
        at = np.take_along_axis(beam[live], top, 1)
        fresh[live[:, None], top] &= ~good
        new = np.where(good[:, :, None], near[at], -1).reshape(len(live), -1)
        new.sort(axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        new[(new[:, :, None] == beam[live][:, None, :]).any(axis=2)] = -1
        found = np.where(new >= 0, np.einsum("nkd,nd->nk", x[new], q[live]), -np.inf).astype(np.float32)
        every, ids = np.concatenate([sims[live], found], axis=1), np.concatenate([beam[live], new], axis=1)
        flag = np.concatenate([fresh[live], new >= 0], axis=1)
        best = np.argpartition(-every, WIDTH - 1, axis=1)[:, :WIDTH]
        sims[live], beam[live], fresh[live] = (np.take_along_axis(v, best, 1) for v in (every, ids, flag))
        beam[live] = np.where(np.isfinite(sims[live]), beam[live], -1)
    return beam


def pruned(x: np.ndarray, own: np.ndarray, cand: np.ndarray, alpha: float) -> np.ndarray:
    """Robust prune of each row of candidates: nearest first; a candidate goes
    that is nearer, by the factor alpha, to one kept already than to the node."""
    v, rows = x[cand], np.arange(len(own))
    to = 1 - np.einsum("nkd,nd->nk", v, x[own])
    far = np.maximum(1 - v @ v.transpose(0, 2, 1), 0)
    alive = (cand >= 0) & (cand != own[:, None])
    out = np.full((len(own), DEGREE), -1)
    for r in range(DEGREE):
        t = np.where(alive, to, np.inf)
        j = t.argmin(axis=1)
        some = t[rows, j] < np.inf
        if not some.any():
            break
        out[some, r] = cand[rows, j][some]
        alive &= alpha * far[rows, j] > to
        alive[rows, j] = False
    return out


def linked_back(x: np.ndarray, near: np.ndarray, own: np.ndarray, links: np.ndarray, alpha: float) -> None:
    """The nodes that `own` link to link back; where there is no room for that
    all their links are pruned again."""
    ends = links.reshape(-1)
    to, back = ends[ends >= 0], np.repeat(own, links.shape[1])[ends >= 0]
    there = (near[to] == back[:, None]).any(axis=1)
    to, back = to[~there], back[~there]
    # nearest first, by the node that is linked to
    order = np.lexsort((-np.einsum("nd,nd->n", x[to], x[back]), to))
    to, back = to[order], back[order]
    first = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.zeros(0, dtype=int)
    rank = np.arange(len(to)) - np.repeat(first, np.diff(np.append(first, len(to))))
    held = (near[to] >= 0).sum(axis=1)
    # links stand in front, so the free places are the last ones
    total = np.repeat(np.diff(np.append(first, len(to))), np.diff(np.append(first, len(to))))
    fits = held + total <= ROOM
    near[to[fits], (held + rank)[fits]] = back[fits]
    tight = np.unique(to[~fits])
    if len(tight):
        more = np.full((len(tight), ROOM), -1)
        some = ~fits & (rank < ROOM)
        more[np.searchsorted(tight, to[some]), rank[some]] = back[some]
        for lo in range(0, len(tight), BATCH):
            part = tight[lo : lo + BATCH]
            links = pruned(x, part, np.concatenate([near[part], more[lo : lo + BATCH]], axis=1), alpha)
            near[part] = -1
            near[part, :DEGREE] = links


def inserted(x: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Links of every node of a flat graph: a pass of insertions and one of
    wider links over all nodes, in an order by hash."""
    n = len(x)
    near = np.full((n, ROOM), -1)
    medoid = int((x @ x.mean(axis=0)).argmax())
    order = np.argsort(mix(ids.astype(np.uint64)), kind="stable")
    order = np.concatenate([[medoid], order[order != medoid]])
    for alpha in (1.0, ALPHA):
        lo = 1 if alpha == 1.0 else 0
        while lo < n:
            own = order[lo : lo + (min(lo, BATCH) if alpha == 1.0 else BATCH)]
            cand = searched(x, near, medoid, x[own])
            links = pruned(x, own, np.concatenate([cand, near[own]], axis=1), alpha)
            near[own] = -1
            near[own, :DEGREE] = links
            linked_back(x, near, own, links, alpha)
            lo += len(own)
    return near


def flat_graph(pdf: pd.DataFrame) -> pd.DataFrame:
    """Adjacency lists (by rep) of one shard's block."""
    pdf = pdf.sort_values("rep")
    ids, x = pdf["rep"].to_numpy(), matrix(pdf["v"])
    near = inserted(x.astype(np.float32), ids)
    links = [dict.fromkeys(row[row >= 0].tolist()) for row in near]
    for i in range(len(ids)):
        for j in list(links[i])[:BACK]:  # nobody is left out: a node's nearest always link back
            links[j].setdefault(i)
    return pd.DataFrame({"rep": ids, "near": [ids[sorted(s)].tolist() for s in links]})


def in_range(x, near, medoid: int, q: np.ndarray, own: int, least: float) -> list[int]:
    """Greedy search from the medoid (and the node itself, if it is here) to
    the nearest nodes, then outwards through all nodes about in range."""
    starts = [medoid] if own < 0 else [own, medoid]
    seen = set(starts)
    sims = {i: float(x[i] @ q) for i in starts}
    todo = [(-s, i) for i, s in sims.items()]
    heapq.heapify(todo)
    best = sorted(sims.values(), reverse=True)
    while todo:
        s, i = heapq.heappop(todo)
        if len(best) >= BEAM and -s < best[BEAM - 1] and -s < least - SLACK:
            break
        fresh = [j for j in near[i] if j not in seen]
        if not fresh:
            continue
        seen.update(fresh)
        values = (x[fresh] @ q).tolist()
        for j, v in zip(fresh, values, strict=True):
            sims[j] = v
            if len(best) < BEAM or v > best[-1] or v >= least - SLACK:
                heapq.heappush(todo, (-v, j))
        best = heapq.nlargest(BEAM, [*best, *values])
    return [i for i, s in sims.items() if s >= least and i != own]


def search_block(least: float):
    def run(key, nodes: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(nodes) or not len(asked):
            return pd.DataFrame({"rep": pd.Series([], dtype="int64"), "found": pd.Series([], dtype="int64"), "root": pd.Series([], dtype="int64")})
        nodes = nodes.sort_values("rep")
        ids, x, weight = nodes["rep"].to_numpy(), matrix(nodes["v"]), nodes["n"].to_numpy()
        place = {int(r): i for i, r in enumerate(ids)}
        near = [[place[j] for j in own if j in place] for own in nodes["near"]]
        medoid = int((x @ x.mean(0)).argmax())
        root: dict[int, int] = {}

        def top(a: int) -> int:
            while root.setdefault(a, a) != a:
                root[a] = root[root[a]]
                a = root[a]
            return a

        counts = []
        for rep, q in zip(asked["rep"].tolist(), matrix(asked["v"]), strict=True):
            hits = in_range(x, near, medoid, q, place.get(rep, -1), least)
            counts.append(int(weight[hits].sum()) if hits else 0)
            for j in hits:
                a, b = top(rep), top(int(ids[j]))
                root[max(a, b)] = min(a, b)
        reps = asked["rep"].tolist()
        more = [r for r in root if r not in set(reps)]
        return pd.DataFrame({"rep": reps + more, "found": counts + [0] * len(more), "root": [top(r) for r in reps + more]})

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.98, audit: float | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of vectors.  With
    audit, a recall below it is an error."""
    units = stored(unit_vectors(vectors).dropDuplicates(["vec_id", "label", "dim", "hash"]), "units")
    nodes = stored(units.groupBy("label", "dim", "hash").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v")).withColumn("rep", F.monotonically_increasing_id()), "nodes")
    placed = sharded(nodes, least)
    size = placed.groupBy("label", "dim", "shard").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.lit(1)).cast("int").alias("blocks"))
    keys = ["label", "dim", "shard", "block"]
    members = stored(placed.join(size, ["label", "dim", "shard"]).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int")), "members")
    built = members.groupBy(*keys).applyInPandas(flat_graph, "rep long, near array<long>")
    united = built.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    graph = members.join(united, "rep").select(*keys, "rep", "v", "n", "near")
    asked = members.where("own").select("label", "dim", "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "rep", "v")
    found = stored(graph.groupBy(*keys).cogroup(renewed(asked).groupBy(*keys)).applyInPandas(search_block(least), "rep long, found long, root long"), "found")
    placed_in = components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    by_rep = found.groupBy("rep").agg(F.sum("found").alias("found")).join(placed_in.withColumnRenamed("node", "rep"), "rep", "left")
    classes = nodes.select("label", "dim", "hash", "rep", "n", "least").join(by_rep, "rep").withColumn("c", F.coalesce("component", "rep"))
    classes = classes.join(classes.groupBy("c").agg(F.min("least").alias("component_id")), "c")
    each = units.select("vec_id", "label", "dim", "hash").join(classes, ["label", "dim", "hash"])
    one = each.groupBy("vec_id").agg(F.max(F.col("found") + F.col("n") - 1).alias("n_links"), F.min("component_id").alias("component_id"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(one, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    out = rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
    if audit is not None:
        out = stored(out, "found")
        if (share := recall(vectors, out, least, max(1, units.count() // ASKED))) < audit:
            raise RuntimeError(f"of the links of {ASKED} vectors only the share {share:.3f} was found")
    return out


def recall(vectors: DataFrame, result: DataFrame, least: float = 0.98, every: int = 50) -> float:
    """Audit: links found, as a share of those that brute force finds, over
    the vectors of every 50th hash (at most 2 * ASKED).  Sampled vectors are
    compared with all rows of their label in blocks.  As no link is found that
    is none, the counts tell which share of the links is there."""
    units = unit_vectors(vectors).dropDuplicates(["vec_id", "label", "dim", "hash"])
    sample = units.where(F.pmod(F.xxhash64("vec_id"), F.lit(every)) == 0).limit(2 * ASKED).collect()
    if not sample:
        return 1.0
    by_key: dict = {}
    for r in sample:
        by_key.setdefault((r.label, r.dim), []).append((r.vec_id, bytes(r.v), bytes(r.hash)))

    def run(batches):
        for b in batches:
            out: dict[tuple, int] = {}
            groups: dict = {}
            for i, label, dim, v in zip(*(c.to_pylist() for c in b.columns[:4]), strict=True):
                groups.setdefault((label, dim), []).append((i, v))
            for key, rows in groups.items():
                if key in by_key:
                    s = matrix(v for _, v, _ in by_key[key]) @ matrix(v for _, v in rows).T >= least
                    same = np.array([i for i, _, _ in by_key[key]])[:, None] == np.array([i for i, _ in rows])
                    for (i, _, h), n in zip(by_key[key], (s & ~same).sum(1).tolist(), strict=True):
                        out[i, h] = out.get((i, h), 0) + n
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary()), pa.array(list(out.values()), pa.int64())], ["vec_id", "hash", "n"])

    # a vec_id of several vectors counts with the one of most links, as above
    truth = units.mapInArrow(run, "vec_id long, hash binary, n long").groupBy("vec_id", "hash").agg(F.sum("n").alias("n")).groupBy("vec_id").agg(F.max("n").alias("n"))
    own = result.groupBy("vec_id").agg(F.max("n_links").alias("n_links"))
    found, there = truth.join(own, "vec_id").agg(F.sum(F.least("n", "n_links")), F.sum("n")).first()
    return 1.0 if not there else found / there
