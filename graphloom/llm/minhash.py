"""Operator 6: MinHash near-dedup with tensored banding.

Documents with equal shingle sets are one class first, so copies, however
many, are counted once.  Each class's text gets a few half keys of a few
minhashes each; all pairs of half keys are the table keys, which needs about
the square root of the minhashes that independent tables would.  With the
defaults (13 half keys of 3) two sets of similarity 0.8 share no table with
probability 0.0013, of 0.85 0.0001, and of 0.9 two in a million.

Two classes that share a table are candidates.  Within a table's bucket every
member is first compared with the least one, which links near copies of one
document, however many, in a number of comparisons that grows with the bucket.
A candidate of these is first judged by sketches, a byte of the least hash in
each of 128 ranges; a pair whose sketches agree 4.5 standard deviations less
than the similarity needs is none (a similar pair is lost so with probability
0.00001).  All others are compared on full sets.

A bucket whose members are then still in several components is gone through
pair by pair across components, on full sets in one task, and only links that
join components leave it.  A bucket that is too large for a task is cut first:
into the groups that share a shingle of their prefixes (a set's rarest shingles,
of which two similar sets share one), and a group that is still too large into
blocks, each seen by all members outside the largest component.  So every pair
that shares a table is compared or in one component already, whatever the
bucket's size.

Edge cases: a null text or one without words has an empty set and links with
nothing; fewer words than a shingle give one shingle; repeated rows of one
doc_id give equal rows; rows of one doc_id with different texts are compared as
documents of their own; null doc_ids are returned, linked with nothing (null
component, kept); texts of any length are read whole; extra columns do not
matter; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import WordHasher, blocks, components, drop_stored, grams, merged, mix, stored, text_bytes

HALVES, DEPTH = 13, 3
#: Ranges of a sketch, a byte each.
RANGES = 128
#: Members of a bucket, or of a part of one, that are compared in one task on
#: average, and their shingles.
BLOCK, BLOCK_SHINGLES = 1024, 2_000_000
#: Shingles and visitors of a block that are compared at a time.
COLUMNS, VISITORS = 4096, 256
#: Bits of the hash by which shingles are counted for the prefixes' order.
COUNT_BITS = 18
#: Values of the hash by which texts are left out before they are shuffled.
FILTER = 1 << 20
#: Bytes of text that are hashed at a time.
TEXT_BLOCK = 500_000


# ------------------------------------------------------- sets and signatures


def shingle_sets(hasher: WordHasher, data, offsets, k: int):
    """For each text the sorted distinct hashes of its k-word shingles."""
    lower = data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
    _, _, doc, words = hasher(lower, offsets)
    n = len(offsets) - 1
    cuts = np.searchsorted(doc, np.arange(n + 1))
    all_grams = grams(words, k)
    for i in range(n):
        lo, hi = cuts[i], cuts[i + 1]
        if hi - lo >= k:
            yield np.unique(all_grams[lo : hi - k + 1])
        elif hi > lo:
            yield mix(grams(words[lo:hi], int(hi - lo)) + np.uint64(hi - lo))
        else:
            yield np.zeros(0, dtype=np.uint64)


def sketched(s: np.ndarray) -> bytes:
    """The least hash of each of RANGES equal ranges as a byte; 0: none."""
    at = np.searchsorted(s, np.arange(RANGES, dtype=np.uint64) * np.uint64((1 << 64) // RANGES))
    full = at < np.append(at[1:], len(s))
    out = np.zeros(RANGES, dtype=np.uint8)
    out[full] = mix(s[at[full]]) % np.uint64(255) + np.uint64(1)
    return out.tobytes()


def signatures(docs: DataFrame, k: int, seed: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, halves, sketch)."""
    multipliers = mix(np.arange(1, HALVES * DEPTH + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)
    names = ["doc_id", "n_shingles", "set_key", "halves", "sketch"]

    def run(batches):
        hasher = WordHasher()
        for b in batches:
            for row, data, offsets in blocks(b, TEXT_BLOCK):
                sets = list(shingle_sets(hasher, data, offsets, k))
                sizes = np.array([len(s) for s in sets])
                some = np.flatnonzero(sizes)
                halves: list = [None] * len(sets)
                if len(some):
                    # the sets of a block one after another, so that each
                    # minhash is three passes over all of them
                    every, begin = np.concatenate(sets), (np.cumsum(sizes) - sizes)[some]
                    low = np.empty((len(some), HALVES * DEPTH), dtype=np.uint64)
                    for j, m in enumerate(multipliers):
                        x = every * m
                        x ^= x >> np.uint64(32)
                        low[:, j] = np.minimum.reduceat(x, begin)
                    low = low.reshape(len(some), HALVES, DEPTH)
                    h = low[:, :, 0]
                    for d in range(1, DEPTH):
                        h = mix(h + low[:, :, d])
                    for i, own in zip(some.tolist(), h.view(np.int64), strict=True):
                        halves[i] = own
                keys = [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets]
                sketches = [sketched(s) if len(s) else None for s in sets]
                ids = b.column(0).slice(row, len(sets))
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(halves, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names)

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, halves array<long>, sketch binary")


def full_sets(nodes: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(node, shingles): the sorted hashes, as bytes, of each of the nodes."""
    own = nodes.select(F.col("rep").alias("doc_id"), "node", "set_key")
    # most texts that nobody asks for stay where they are: what is broadcast are
    # hashes of the ids asked for, FILTER at most
    mark = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER)).alias("mark")
    near = texts.select("*", mark).join(F.broadcast(own.select(mark).distinct()), "mark", "left_semi")
    wanted = merged(near.select("doc_id", "text"), own, "doc_id").select("node", "set_key", "text")

    def run(batches):
        hasher = WordHasher()
        for b in batches:
            for row, data, offsets in blocks(b, TEXT_BLOCK):
                out = [s.tobytes() for s in shingle_sets(hasher, data, offsets, k)]
                own = pa.array([x if hashlib.md5(x).digest() == y.as_py() else None for x, y in zip(out, b.column(1).slice(row, len(out)), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, len(out)), own], ["node", "shingles"]).filter(own.is_valid())

    # a doc_id with several rows has its set several times
    return wanted.mapInArrow(run, "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))


# --------------------------------------------------------------------- pairs


def least_equal(union, percent: int):
    """Equal ranges that a similar pair has, less 4.5 deviations, of so many
    that either set has."""
    p = percent / 100
    return union * p - 4.5 * np.sqrt(union * (p * (1 - p)))


def likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sizes and sketches don't rule them out."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"of_{x}"))
    both = merged(merged(pairs, side("b"), "b"), side("a"), "a").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)

    def run(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(c.to_pylist()), dtype=np.uint8).reshape(-1, RANGES) for c in (b.column(2), b.column(3)))
            union, equal = ((x > 0) | (y > 0)).sum(axis=1), ((x == y) & (x > 0)).sum(axis=1)
            yield b.select([0, 1]).filter(pa.array(equal >= least_equal(union, percent)))

    return both.select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""
    pairs = stored(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = full_sets(merged(nodes.select("node", "rep", "set_key"), wanted, "node", "left_semi"), texts, k)
    sides = merged(merged(pairs, sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b"), sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                inner = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * inner >= percent * (len(x) + len(y) - inner))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    out = stored(sides.select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long"), "links")
    drop_stored(pairs)
    return out


# ------------------------------------------------------------------- buckets


def table_keys(nodes: DataFrame) -> DataFrame:
    """(key, b): a key for each pair of half keys."""
    i, j = (list(x) for x in zip(*itertools.combinations(range(HALVES), 2), strict=True))

    def run(batches):
        place = mix(np.arange(1, HALVES + 1, dtype=np.uint64))  # no two tables share keys
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                b = batch.slice(lo, 1000)
                own = mix(np.array(b.column(1).to_pylist(), dtype=np.int64).view(np.uint64) + place)
                keys = mix(own[:, i] + own[:, j]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(b.column(0).to_numpy(), keys.shape[1]))], ["key", "b"])

    return nodes.select("node", "halves").mapInArrow(run, "key long, b long")


def prefix_keys(sets: DataFrame, percent: int) -> DataFrame:
    """(key, b): the rarest shingles of each set, so many that two similar sets
    share one.  Any order that is the same for all sets does; here it is by the
    count of a shingle's hash among 2 ** COUNT_BITS, then by the shingle."""
    spread = np.uint64(64 - COUNT_BITS)

    def count(batches):
        total = np.zeros(1 << COUNT_BITS, dtype=np.int64)
        for b in batches:
            for s in b.column(0):
                np.add.at(total, (mix(np.frombuffer(s.as_py(), np.uint64)) >> spread).astype(np.int64), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bin", "n"])

    def packed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.stack([c.to_numpy() for c in b.columns]).tobytes()], pa.binary())], ["counts"])

    counts = np.zeros(1 << COUNT_BITS, dtype=np.int64)
    for row in sets.select("shingles").mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).mapInArrow(packed, "counts binary").toLocalIterator():
        at, n = np.frombuffer(row.counts, dtype=np.int64).reshape(2, -1)
        counts[at] = n
    sent = sets.sparkSession.sparkContext.broadcast(counts)  # 2 MB, whatever the input

    def run(batches):
        for b in batches:
            for node, s in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = np.frombuffer(s.as_py(), np.uint64)
                least = -(-len(s) * percent // 100)
                rare = s[np.lexsort((s, sent.value[(mix(s) >> spread).astype(np.int64)]))[: len(s) - least + 1]]
                yield pa.RecordBatch.from_arrays([pa.array(rare.view(np.int64)), pa.array(np.full(len(rare), node))], ["key", "b"])

    return sets.select("node", "shingles").mapInArrow(run, "key long, b long")


def bucketed(rows: DataFrame) -> DataFrame:
    """Rows (key, b) with each bucket's size and least member a; buckets of one
    member go."""
    return merged(rows, rows.groupBy("key").agg(F.min("b").alias("a"), F.count("*").alias("size")).where("size > 1"), "key")


def still_open(rows: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(key, b, c, top, parts): members of the buckets that hold several
    components c; top is the largest of these, parts the number of tasks that
    the bucket needs.  Of buckets of the same members one is enough."""
    sized = merged(rows, nodes.select(F.col("node").alias("b"), "n"), "b")
    placed = merged(sized, found.select(F.col("node").alias("b"), "component"), "b", "left").select("key", "b", F.coalesce("component", "b").alias("c"), "n")
    kinds = placed.groupBy("key", "c").agg(F.count("*").alias("m"), F.sum("n").alias("n"), F.bit_xor(F.xxhash64("b")).alias("mark"))
    kinds = kinds.groupBy("key").agg(F.max_by("c", F.struct("m", "c")).alias("top"), F.count("*").alias("kinds"), F.sum("m").alias("m"), F.sum("n").alias("n"), F.bit_xor("mark").alias("mark"))
    one = kinds.where("kinds > 1").groupBy("mark", "m", "n").agg(F.min(F.struct("key", "top")).alias("k"))
    parts = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("n") / BLOCK_SHINGLES)).cast("int")
    return stored(merged(placed.select("key", "b", "c"), one.select("k.key", "k.top", parts.alias("parts")), "key"), "open")


class Block:
    """Members of one block on full sets, and which components they join."""

    def __init__(self, percent: int) -> None:
        self.percent, self.root = percent, {}
        self.data: list[tuple] = []

    def top(self, x: int) -> int:
        while self.root.setdefault(x, x) != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def links(self, asked: list[tuple]):
        """Links (b, b) of those asked with the block's members that join two
        components.  Rows are (b, c, shingles)."""
        every = [*asked, *self.data]
        sizes = np.array([len(x[2]) for x in every])
        values = np.concatenate([x[2] for x in every])
        _, at, times = np.unique(values, return_inverse=True, return_counts=True)
        column = np.cumsum(times > 1) - 1
        fine = times[at] > 1  # a shingle of one member is in no intersection
        owner, at = np.repeat(np.arange(len(every)), sizes)[fine], column[at[fine]]
        order = np.argsort(at, kind="stable")
        owner, at = owner[order], at[order]
        n, inner = len(asked), np.zeros((len(asked), len(self.data)), dtype=np.float32)
        for lo in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
            i, j = np.searchsorted(at, [lo, lo + COLUMNS])
            held = np.zeros((len(every), min(COLUMNS, int(at[-1]) + 1 - lo)), dtype=np.float32)
            held[owner[i:j], at[i:j] - lo] = 1
            inner += held[:n] @ held[n:].T
        union = sizes[:n][:, None] + sizes[n:] - inner
        for x, y in zip(*np.nonzero(100 * inner >= self.percent * union), strict=True):
            a, b = self.top(asked[x][1]), self.top(self.data[y][1])
            if a != b:
                self.root[max(a, b)] = min(a, b)
                yield asked[x][0], self.data[y][0]


def open_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of members of one bucket in different components, as many
    as join these.

    A pair has a member outside the largest component; these visit every block
    of their bucket, and all others stay in their own, so that near copies of
    one document, however many, are moved once."""
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("b"), "parts").cast("int")).withColumn("out", F.col("c") != F.col("top"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    dealt = dealt.select("key", "b", "c", "out", "own", F.explode(F.when(F.col("out"), every).otherwise(F.array("own"))).alias("block"))
    dealt = merged(dealt, sets.select(F.col("node").alias("b"), "shingles"), "b").select("key", "block", (F.col("own") != F.col("block")).alias("visits"), "out", "b", "c", "shingles")

    def run(batches):
        now, block, asked, found = None, Block(percent), [], []

        def ask():
            if asked and block.data:
                found.extend(block.links(asked))
            asked.clear()

        def sent():
            a, b = ([x[i] for x in found] for i in (0, 1))
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for key, part, visits, out, b, c, shingles in zip(*(x.to_pylist() for x in batch.columns[:6]), batch.column(6), strict=True):
                if now != (key, part):
                    ask()
                    now, block = (key, part), Block(percent)
                row = (b, c, np.frombuffer(shingles.as_py(), np.uint64))
                if not visits:  # these come first, so the block is whole when asked
                    block.data.append(row)
                elif len(asked) >= VISITORS:
                    ask()
                if out:
                    asked.append(row)
            if found:
                yield sent()
        ask()
        if found:
            yield sent()

    return dealt.repartition("key", "block").sortWithinPartitions("key", "block", "visits").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80, seed: int = 7) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    texts = text_bytes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id")
    signed = stored(signatures(texts, k, seed), "signed")
    classes = signed.where("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("halves").alias("halves"), F.first("sketch").alias("sketch"))
    nodes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    members = stored(bucketed(table_keys(nodes)), "members")
    first = confirmed(likely(members.where("a <> b").select("a", "b").distinct(), nodes, percent), nodes, texts, k, percent)
    found = stored(components(first), "components")
    rows = still_open(members.where("size > 2"), nodes, found)
    asked = merged(nodes.select("node", "rep", "set_key"), rows.select(F.col("b").alias("node")).distinct(), "node", "left_semi")
    sets = stored(full_sets(asked, texts, k), "sets")
    second = open_links(rows.where("parts = 1"), sets, percent)
    large = rows.where("parts > 1")
    if not large.isEmpty():
        inside = merged(sets, large.select(F.col("b").alias("node")).distinct(), "node", "left_semi")
        sub = stored(bucketed(prefix_keys(inside, percent)), "prefixes")
        second = second.unionByName(open_links(still_open(sub, nodes, found), sets, percent))
    edges = stored(second.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b"))), "links")
    found = stored(components(edges), "components")
    drop_stored(members, rows, sets)
    named = merged(nodes.select("node", "set_key", "rep"), found, "node", "left").withColumn("c", F.coalesce("component", "node"))
    label = merged(named, named.groupBy("c").agg(F.min("rep").alias("component_id")), "c").select("set_key", "component_id")
    out = merged(signed.select("doc_id", "n_shingles", "set_key"), label, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
