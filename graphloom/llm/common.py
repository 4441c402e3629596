"""What several operators share: shared tables, word hashing, components."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

MIX_1, MIX_2, BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


# ----------------------------------------------------------------- tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or
    one of our own where none is set (local runs and tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str = "t", **options) -> DataFrame:
    """Write df as Parquet, with the writer's options, into the shared folder
    and read it back.

    Cuts the lineage: a lost executor costs no more than the rest of a stage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def stored_in_batches(df: DataFrame, rows: int, name: str = "t") -> DataFrame:
    """stored(), with at most so many rows in a batch that goes to Python.

    A batch is held once or twice in the JVM (its buffers grow by doubling) and
    twice in the worker (the next one is read before the last is let go); the
    setting is the session's, so the table is written here and it is put back.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    if 0 < int(before) <= rows:
        return stored(df, name)
    try:
        conf.set(key, str(rows))
        return stored(df, name)
    finally:
        conf.set(key, before)


def drop_stored(*frames: DataFrame) -> None:
    """Remove the files of tables that stored() wrote and no plan needs now."""
    for df in frames:
        path = getattr(df, "_stored_at", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def give_back() -> None:
    """Return the memory that this worker has freed to the system: Spark uses
    workers again, and they keep what earlier tasks of any operator had."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not glibc


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def long_id(df: DataFrame, name: str = "doc_id"):
    """The id as long; a plain column where it is one already, so that plans
    of the same scan stay the same and Spark reuses their exchanges."""
    return F.col(name) if df.schema[name].dataType.simpleString() == "bigint" else F.col(name).cast("long").alias(name)


def text_bytes(df: DataFrame, *keys: str) -> DataFrame:
    """keys and the text as bytes (null: empty), which need no decoding."""
    return df.select(*keys, F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


def merged(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """An equi-join that is sorted and merged: files of a few repeated keys look
    small enough to broadcast when their rows are not."""
    return left.hint("merge").join(right.hint("merge"), on, how)


def renewed(df: DataFrame) -> DataFrame:
    """df with columns of its own identity, to be joined with its kin."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))


# ---------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_1
    x ^= x >> np.uint64(27)
    x = x * MIX_2
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i < n, by doubling."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    have, step = 1, base
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(step)
        have, step = have * 2, step * step & 0xFFFFFFFFFFFFFFFF
    return out


class WordHasher:
    """Words and their 64-bit hashes for a block of texts, in numpy.

    Each word's hash is that of a prefix-sum polynomial over its bytes, so
    the cost is a few vector operations a byte and no Python per word.
    """

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def __call__(self, data: np.ndarray, offsets: np.ndarray):
        """data: the bytes of all texts; offsets: where each begins, and the
        end.  Returns starts, ends, text number and hash of every word."""
        n = len(data)
        if len(self.up) < n + 1:
            self.up, self.down = powers(BASE, n + 1), powers(BASE_INVERSE, n + 1)
        solid = ~SPACE[data]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        cuts = offsets[:-1]
        cuts = cuts[cuts < n]
        first[cuts] = solid[cuts]
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        inner = cuts[cuts > 0] - 1
        last[inner] = solid[inner]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=total[1:])
        own = (total[ends] - total[starts]) * self.down[starts]
        own = mix(own + (ends - starts).astype(np.uint64) * np.uint64(BASE))
        return starts, ends, np.searchsorted(offsets, starts, side="right") - 1, own


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on (the last n - 1 have none)."""
    m = max(len(words) - n + 1, 0)
    out = np.zeros(m, dtype=np.uint64)
    for i in range(n):
        out = out * np.uint64(BASE) + words[i : i + m]
    return mix(out)


def blocks(batch, most: int = 1_000_000):
    """Cut an Arrow batch whose last column is binary into runs of rows of at
    most about `most` bytes: (first row, bytes, offsets from 0)."""
    column = batch.column(batch.num_columns - 1)
    if not len(column):
        return
    width = np.int64 if str(column.type).startswith("large") else np.int32
    at = np.frombuffer(column.buffers()[1], dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        j = min(j, len(column))
        yield i, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


# ------------------------------------------------------------- components


#: Links up to which components are found in one task (about 10 MB there).
ONE_TASK = 200_000


def united(edges: DataFrame) -> DataFrame:
    """Components of a bounded number of links (u, v), by union-find."""

    def run(batches):
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                u, v = top(u), top(v)
                root[max(u, v)] = min(u, v)
        nodes = list(root)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], ["node", "component"])

    return edges.coalesce(1).mapInArrow(run, "node long, component long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star.

    edges: columns a, b (long).  Returns (node, component) for every node
    with an edge; component is its smallest member.  A round is two
    aggregations with map-side combine and two joins that AQE can split;
    links never reach the driver, only a count and a checksum do.  Few links
    (at most ONE_TASK) are united in one task, which needs no rounds.
    """
    one = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    now, seen = stored(one, "links"), None
    if now.count() <= ONE_TASK:
        return united(now)
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = merged(both.where("v > u"), low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = merged(large, low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(low.select("u", F.col("m").alias("v")))
        after = stored(small.distinct(), "links")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_stored(now)
        now = after
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
