"""Operator 2: exact top-k search as a Voronoi kNN join.

Vectors are integers, floor(64 * x); the score is the inner product.  About
sqrt(n) pivots (a sample, `MOST_PIVOTS` at most, by length of the vectors) cut
the queries into Voronoi cells, and cells that are neighbours into groups of
bounded size.  A vector x and a query cell of pivot p and radius r, its
farthest query, bound the scores of the two: p x - r |x| <= q x <= p x + r |x|.

1. Each task sums up its rows: for every query cell, the k + 1 best scores that
   they surely reach.  Together these give a score that the k best of every
   query of the cell reach (one of the k + 1 may be the query itself).
2. A vector is sent to the groups of those cells only whose score its upper
   bound reaches, so only necessary data are replicated.
3. Groups are solved locally, a block of data and one of queries in a task; of
   a block's k best only those leave it that reach the cell's score.

Pivots only decide how much is compared.  Lengths beyond the `MOST_LENGTHS`
most frequent have none; each of them is compared in blocks as a whole.

Edge cases: vectors that are null or hold null or non-finite components take
no part; only vectors of equal length are compared; ties go to the smaller
vec_id; repeated rows of one vec_id count once (the least vector); a query
without other vectors has no rows; an empty table gives an empty result; extra
columns do not matter.  Components beyond 2**62 and scores beyond the range of
long are cut there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import merged, renewed, stored

#: Rows of a block of data and of queries.
DATA_BLOCK, QUERY_BLOCK = 4096, 2048
#: What is broadcast: pivots, their bytes, lengths that have some, query groups.
MOST_PIVOTS, MOST_BYTES, MOST_LENGTHS, MOST_GROUPS = 4096, 32_000_000, 256, 100_000
LIMIT = float(1 << 62)


def usable(df: DataFrame, vector: str = "embedding"):
    """Rows whose vector is there and has only finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & fine)


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, v): the integer vector's bytes (64-bit)."""
    one = usable(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).groupBy("vec_id").agg(F.min("e").alias("e"))

    def run(batches):
        for b in batches:
            raw = [np.clip(np.floor(64 * np.asarray(x, dtype=float)), -LIMIT, LIMIT).astype(np.int64) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in raw], pa.int32()), pa.array([x.tobytes() for x in raw], pa.binary())], ["vec_id", "dim", "v"])

    return one.mapInArrow(run, "vec_id long, dim int, v binary")


def chosen_pivots(ints: DataFrame) -> dict[int, np.ndarray]:
    """Pivots of each of the most frequent lengths, neighbours in a row."""
    counts = {r.dim: r["count"] for r in ints.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(MOST_LENGTHS).collect()}
    want = {d: max(1, int(n**0.5)) for d, n in counts.items()}
    room = min(1.0, MOST_PIVOTS / max(sum(want.values()), 1), MOST_BYTES / max(sum(8 * d * p for d, p in want.items()), 1))
    want = {d: max(1, int(p * room)) for d, p in want.items()}
    if not want:
        return {}
    # about twice as many by hash, and of these the first ones
    share = F.create_map(*(F.lit(x) for d, p in want.items() for x in (d, min(1.0, 2 * p / counts[d] + 8 / counts[d]))))
    mark = F.xxhash64("vec_id", F.lit(3))
    rows = ints.where(share[F.col("dim")].isNotNull() & (F.pmod(mark, F.lit(1 << 30)) < share[F.col("dim")] * (1 << 30))).select("dim", mark.alias("mark"), "v").collect()
    out = {}
    for dim, p in want.items():
        own = sorted((r.mark, bytes(r.v)) for r in rows if r.dim == dim)[:p]
        x = np.frombuffer(b"".join(v for _, v in own), dtype=np.int64).reshape(len(own), dim).astype(float)
        out[dim] = in_a_row(np.unique(x, axis=0) if len(own) and dim else np.zeros((1, dim)))
    return out


def in_a_row(x: np.ndarray) -> np.ndarray:
    """Rows so that neighbours are near: halves by the widest component."""
    if len(x) < 3:
        return x
    order = np.argsort(x[:, np.ptp(x, axis=0).argmax()], kind="stable")
    return np.concatenate([in_a_row(x[order[: len(x) // 2]]), in_a_row(x[order[len(x) // 2 :]])])


def by_length(batch, pivots: dict[int, np.ndarray]):
    """(rows, vectors, pivots) of each length with pivots, in blocks."""
    dims = batch.column(1).to_numpy()
    for dim in np.unique(dims).tolist():
        if dim in pivots:
            every = np.flatnonzero(dims == dim)
            for lo in range(0, len(every), 1024):
                own = every[lo : lo + 1024]
                yield dim, own, np.frombuffer(b"".join(batch.column(2)[i].as_py() for i in own.tolist()), dtype=np.int64).reshape(len(own), dim).astype(float), pivots[dim]


def query_cells(asked: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Queries with the cell of the nearest pivot and how far that is."""

    def run(batches):
        for b in batches:
            cell, far = np.zeros(b.num_rows, dtype=np.int32), np.zeros(b.num_rows)
            for _, own, x, p in by_length(b, pivots):
                d = np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ p.T + (p**2).sum(1), 0))
                cell[own], far[own] = d.argmin(1), d.min(1) * (1 + 1e-9) + 1e-3
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell), pa.array(far), b.column(2)], ["vec_id", "dim", "cell", "far", "v"])

    return asked.mapInArrow(run, "vec_id long, dim int, cell int, far double, v binary")


def bounds(x: np.ndarray, p: np.ndarray, far: np.ndarray):
    """Of each vector and query cell: the lower and upper bound of scores."""
    norm, mid = np.sqrt((x**2).sum(1)), x @ p.T
    reach = norm[:, None] * far
    slack = 1e-9 * (np.abs(mid) + reach) + 1
    return mid - reach - slack, mid + reach + slack


def sure_scores(ints: DataFrame, pivots: dict[int, np.ndarray], far: dict[int, np.ndarray], k: int) -> dict[int, np.ndarray]:
    """For each cell a score that k vectors besides the query surely reach."""
    fields = "dim int, cell int, low array<double>"

    def rows_of(best):
        dims = [d for d, top in best.items() for _ in range(top.shape[1])]
        cells = [c for top in best.values() for c in range(top.shape[1])]
        return pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array(cells, pa.int32()), pa.array([t for top in best.values() for t in top.T.tolist()], pa.list_(pa.float64()))], ["dim", "cell", "low"])

    def run(batches):
        best = {d: np.full((k + 1, len(p)), -np.inf) for d, p in pivots.items()}
        for b in batches:
            for dim, _, x, p in by_length(b, pivots):
                both = np.concatenate([best[dim], bounds(x, p, far[dim])[0]])
                best[dim] = np.partition(both, len(both) - k - 1, axis=0)[-k - 1 :]
        yield rows_of(best)

    def merge(batches):
        best: dict = {}
        for b in batches:
            for dim, cell, low in zip(*(c.to_pylist() for c in b.columns), strict=True):
                best[dim, cell] = sorted([*best.get((dim, cell), []), *low])[-k - 1 :]
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in best], pa.int32()), pa.array([x[1] for x in best], pa.int32()), pa.array([v[0] for v in best.values()], pa.float64())], ["dim", "cell", "low"])

    out = {d: np.full(len(p), -np.inf) for d, p in pivots.items()}
    for r in ints.select("vec_id", "dim", "v").mapInArrow(run, fields).repartition("dim", "cell").mapInArrow(merge, "dim int, cell int, low double").collect():
        out[r.dim][r.cell] = min(r.low, 9.2e18)
    return out


def cell_groups(cells) -> tuple[dict, int]:
    """(dim, cell) -> (first group, groups).  Cells in a row share a group of at
    most QUERY_BLOCK queries; a cell of more has several."""
    most = max(QUERY_BLOCK, -(-2 * sum(c.n for c in cells) // MOST_GROUPS))
    out, n, held, dim = {}, 0, 0, None
    for c in sorted(cells, key=lambda c: (c.dim, c.cell)):
        groups = -(-c.n // most)
        if n and groups == 1 and c.dim == dim and held + c.n <= most:
            held += c.n
            out[c.dim, c.cell] = (n - 1, 1)
            continue
        out[c.dim, c.cell] = (n, groups)
        n, dim, held = n + groups, c.dim, c.n if groups == 1 else most
    return out, n


def needed_by(ints: DataFrame, pivots: dict, far: dict, sure: dict, groups: dict) -> DataFrame:
    """vectors with the query groups that need them."""
    first = {d: np.array([groups.get((d, c), (-1, 0)) for c in range(len(p))]) for d, p in pivots.items()}

    def run(batches):
        for b in batches:
            out: list = [[] for _ in range(b.num_rows)]
            for dim, own, x, p in by_length(b, pivots):
                need = (bounds(x, p, far[dim])[1] >= sure[dim]) & (first[dim][:, 1] > 0)
                for i, row in zip(own.tolist(), need, strict=True):
                    some = first[dim][row]
                    out[i] = np.unique(np.concatenate([np.arange(a, a + n) for a, n in some])) if (some[:, 1] > 1).any() else np.unique(some[:, 0])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int32())), b.column(2)], ["vec_id", "dim", "groups", "v"])

    return ints.select("vec_id", "dim", "v").mapInArrow(run, "vec_id long, dim int, groups array<int>, v binary")


def best_of_block(k: int):
    def run(key, data: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "vec_id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="int64")})
        if not len(data) or not len(queries):
            return none
        data = data.sort_values("vec_id")
        ids, dim = data["vec_id"].to_numpy(), int(data["dim"].iloc[0])
        x = np.frombuffer(b"".join(data["v"]), dtype=np.int64).reshape(len(data), dim)
        q, sure = np.frombuffer(b"".join(queries["v"]), dtype=np.int64).reshape(len(queries), dim), queries["sure"].to_numpy()
        small = dim == 0 or float(np.abs(x).max()) * float(np.abs(q).max()) * dim < 2**53
        out = []
        for lo in range(0, len(q), 256):
            own = queries["vec_id"].to_numpy()[lo : lo + 256]
            if small:
                scores = (q[lo : lo + 256].astype(float) @ x.T.astype(float)).astype(np.int64)
            else:
                exact = q[lo : lo + 256].astype(object) @ x.T.astype(object)
                scores = np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)
            for qid, least, row in zip(own.tolist(), sure[lo : lo + 256].tolist(), scores, strict=True):
                at = np.flatnonzero((ids != qid) & (row >= least))
                n, row = len(at), row[at]
                if not n:
                    continue
                if n > k:
                    hit = np.flatnonzero(row >= np.partition(row, n - k)[n - k])
                    at, row = at[hit], row[hit]
                order = np.argsort(-row.astype(float) if small else [-int(r) for r in row], kind="stable")[:k]
                out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[at[order]], "score": row[order]}))
        return pd.concat(out) if out else none

    return run


def blocks_of_lengths(rare: DataFrame, asks):
    """Data and queries of the lengths without pivots: every block of data with
    every one of queries of its length."""
    sizes = rare.groupBy("dim").agg(F.ceil(F.count("*") / DATA_BLOCK).cast("int").alias("blocks"), F.ceil(F.count(F.when(asks, 1)) / QUERY_BLOCK).cast("int").alias("parts")).where("parts > 0")
    keyed = merged(rare, sizes, "dim").withColumn("own", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int")).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), "parts").cast("int"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    data = keyed.select(upto("parts").alias("g"), "dim", F.col("own").alias("block"), "vec_id", "v").withColumn("g", -1 - F.col("g"))
    asked = keyed.where(asks).select((-1 - F.col("part")).alias("g"), "dim", upto("blocks").alias("block"), "vec_id", F.lit(float("-inf")).alias("sure"), "v")
    return data, asked


def top_k(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score for queries whose vec_id % every == 0."""
    spark, asks = vectors.sparkSession, F.col("vec_id") % every == 0
    ints = stored(integers(vectors), "integers")
    pivots = chosen_pivots(ints)
    rare = ints.where(~F.col("dim").isin(list(pivots)))
    data, asked = blocks_of_lengths(rare, asks)
    if pivots:
        queries = stored(query_cells(ints.where(asks & F.col("dim").isin(list(pivots))), pivots), "queries")
        cells = queries.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()
        far = {d: np.zeros(len(p)) for d, p in pivots.items()}
        for c in cells:
            far[c.dim][c.cell] = c.far
        sure, (groups, _) = sure_scores(ints, pivots, far, k), cell_groups(cells)
        needed = stored(needed_by(ints, pivots, far, sure, groups), "needed").select(F.explode("groups").alias("g"), "dim", "vec_id", "v")
        sizes = needed.groupBy("g").agg(F.ceil(F.count("*") / DATA_BLOCK).cast("int").alias("blocks")).collect()
        of_group = F.broadcast(spark.createDataFrame([(r.g, r.blocks) for r in sizes], "g int, blocks int"))  # MOST_GROUPS at most
        of_cell = F.broadcast(spark.createDataFrame([(*at, *groups[at], float(sure[at[0]][at[1]])) for at in groups], "dim int, cell int, first int, parts int, sure double"))  # one a pivot
        near = needed.join(of_group, "g").select("g", "dim", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"), "vec_id", "v")
        own = queries.join(of_cell, ["dim", "cell"]).withColumn("g", (F.col("first") + F.pmod(F.xxhash64("vec_id", F.lit(1)), "parts")).cast("int"))
        own = own.join(of_group, "g").select("g", "dim", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "vec_id", "sure", "v")
        data, asked = data.unionByName(near), asked.unionByName(own)
    keys = ["g", "dim", "block"]
    found = data.groupBy(*keys).cogroup(renewed(asked).groupBy(*keys)).applyInPandas(best_of_block(k), "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
