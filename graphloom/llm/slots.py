"""Operator 10: training-order materialisation of token-ID sequences.

Each document's token ids, with an end mark after them, follow one another, and
a writing task's ids are cut into sequences of a fixed number of ids (only its
last one is filled up by end marks).  The ids are written once, and with them
what numbers the sequences: the task, and how many ids it had before the row.
Only one number a task reaches the driver, and all later passes read the numbers
with the rows, so neither the split of the files nor lost executors can change
them.  A keyed Feistel permutation with cycle-walking takes number i of n to its
slot, a bijection of 0 .. n - 1.  Slots are dealt by range: shard s holds the
slots from s * per_shard on, in order, and is one file of records of one fixed
stride (the ids, little-endian, and a line feed).  Pieces of documents go to
their shard with slot and place; a shard in which a slot is not filled exactly is
an error.  So slot x stands at byte (x mod per_shard) * stride of shard x div
per_shard, and training can read on from any slot.

The query's ids are those of a public byte-level BPE vocabulary (two bytes
each), by the tiktoken library; ids from elsewhere go through `packed_ids`.

Edge cases: a null text has no ids but its end mark, so every row of the input
has a piece of a sequence; repeated rows have their own; null doc_ids are kept; texts and
ids of any length are cut whole; extra columns do not matter; an empty table
gives an empty result and no shards.  The order is the same for the same files
and split size.
"""

from __future__ import annotations

import base64
import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import mix, shared_dir, stored, text_bytes

ROUNDS = 6
#: Sequences of a shard (32 MB with 512 ids of two bytes).
PER_SHARD = 32_768
#: Ids pack well; they stand beside the shards until the manifest is read.
SMALL = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9"}
#: Bytes of a vocabulary that may be sent to the tasks.
MOST_BYTES = 64_000_000


class Feistel:
    """A keyed permutation of 0 .. n - 1."""

    def __init__(self, n: int, key: int) -> None:
        self.n, self.half = n, max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & 0xFFFFFFFFFFFFFFFF))

    def once(self, x: np.ndarray, keys) -> np.ndarray:
        low = np.uint64((1 << self.half) - 1)
        a, b = x >> np.uint64(self.half), x & low
        for k in keys:
            a, b = b, a ^ (mix(b + k) & low)
        return a << np.uint64(self.half) | b

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        x = self.once(numbers.astype(np.uint64), self.keys)
        while (out := x >= np.uint64(self.n)).any():  # walk the cycle back in
            x[out] = self.once(x[out], self.keys)
        return x.astype(np.int64)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        """The inverse: which sequence stands in a slot."""

        def back(x):
            low = np.uint64((1 << self.half) - 1)
            a, b = x >> np.uint64(self.half), x & low
            for k in self.keys[::-1]:
                a, b = b ^ (mix(a + k) & low), a
            return a << np.uint64(self.half) | b

        x = back(slots.astype(np.uint64))
        while (out := x >= np.uint64(self.n)).any():
            x[out] = back(x[out])
        return x.astype(np.int64)


class Vocabulary:
    """Byte-level BPE from a file of ranks; the end mark is the first free id."""

    held: dict = {}

    def __init__(self, raw: bytes, pattern: str) -> None:
        ranks = {base64.b64decode(t): int(n) for t, n in (line.split() for line in raw.splitlines())}
        self.own, self.end = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1

    @classmethod
    def of(cls, raw: bytes, pattern: str) -> Vocabulary:
        """One a worker: building it takes longer than many batches do."""
        key = (zlib.crc32(raw), len(raw), pattern)
        if key not in cls.held:
            cls.held = {key: cls(raw, pattern)}
        return cls.held[key]


def vocabulary_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        raw = f.read()
    if len(raw) > MOST_BYTES:
        raise ValueError(f"{path} has over {MOST_BYTES} bytes")
    return raw


def token_ids(docs: DataFrame, path: str, pattern: str, width: int = 2) -> DataFrame:
    """(doc_id, ids): each whole text's ids, of `width` bytes each."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary_bytes(path))

    def run(batches):
        own = Vocabulary.of(sent.value, pattern).own
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                raw = [np.asarray(own.encode_ordinary(t.as_py().decode("utf-8", "replace")), dtype=f"<u{width}").tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(raw, pa.binary())], ["doc_id", "ids"])

    return text_bytes(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").mapInArrow(run, "doc_id long, ids binary")


def packed_ids(tokens: DataFrame, width: int) -> DataFrame:
    """(doc_id, token_ids array<int>) -> (doc_id, ids) of width bytes each."""

    def run(batches):
        for b in batches:
            raw = [np.asarray(x or [], dtype=f"<u{width}").tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["doc_id", "ids"])

    return tokens.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, ids binary")


def placed(ids: DataFrame, width: int) -> DataFrame:
    """ids with the task that wrote a row, the ids before the row there and its
    number of ids, end mark included."""

    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            count = np.array([len(x.as_py()) // width + 1 for x in b.column(1)], dtype=np.int64)
            first = at + np.cumsum(count) - count
            at += int(count.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(count), part, dtype=np.int32)), pa.array(first), pa.array(count), *b.columns], ["part", "first", "n", "doc_id", "ids"])

    return ids.select("doc_id", "ids").mapInArrow(run, "part int, first long, n long, doc_id long, ids binary")


def pieces(batches, layout: dict, bases: dict[int, int]):
    """Blocks of pieces, a document's share of a sequence each: doc_ids, chunks,
    slots, places in the sequence, sizes in ids, and all their bytes."""
    width, length = layout["width"], layout["length"]
    end, order = int(layout["end"]).to_bytes(width, "little"), Feistel(layout["n"], layout["key"])
    for b in batches:
        docs, column, lo = b.column(3).to_pylist(), b.column(4), 0
        base = np.array([bases[p] for p in b.column(0).to_pylist()], dtype=np.int64)
        first, n = b.column(1).to_numpy(), b.column(2).to_numpy()
        while lo < len(docs):
            hi = max(lo + 1, int(np.searchsorted(np.cumsum(n[lo:]), 2_000_000)) + lo)
            data = b"".join(x for i in range(lo, hi) for x in (column[i].as_py(), end))
            begin, size = first[lo:hi], n[lo:hi]
            count = (begin + size - 1) // length - begin // length + 1
            row = np.repeat(np.arange(hi - lo), count)
            chunk = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            number = begin[row] // length + chunk
            start = np.maximum(number * length, begin[row])
            stop = np.minimum((number + 1) * length, (begin + size)[row])
            yield [docs[lo + i] for i in row.tolist()], chunk, order.slots(base[lo:hi][row] + number), start - number * length, stop - start, data
            lo = hi


def manifest_rows(ids: DataFrame, layout: dict, bases: dict[int, int]) -> DataFrame:
    def run(batches):
        for own, chunk, slots, at, size, data in pieces(batches, layout, bases):
            cuts = np.cumsum(size) * layout["width"]
            crc = [zlib.crc32(data[i:j]) for i, j in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(own, pa.int64()), pa.array(chunk.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(crc, pa.int64())], ["slot", "doc_id", "chunk", "place", "n_tokens", "crc32"])

    return ids.mapInArrow(run, "slot long, doc_id long, chunk int, place int, n_tokens int, crc32 long")


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] numbers, then start[1], ..."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def shard_blobs(ids: DataFrame, layout: dict, bases: dict[int, int]) -> DataFrame:
    """(shard, blob): a block's pieces for one shard, compressed together for
    the way there: how many, their slots, places and sizes, and their ids."""
    width = layout["width"]

    def run(batches):
        packer = zstandard.ZstdCompressor(level=3)
        for _, _, slots, at, size, data in pieces(batches, layout, bases):
            begin, raw = np.cumsum(size) - size, np.frombuffer(data, dtype=np.uint8).reshape(-1, width)
            order = np.argsort(slots, kind="stable")
            shards, first = np.unique(slots[order] // layout["per_shard"], return_index=True)
            blobs = []
            for i, j in zip(first, [*first[1:], len(order)], strict=True):
                own = order[i:j]
                head = np.stack([slots[own], at[own], size[own]]).astype(np.int64)
                blobs.append(packer.compress(np.int64(len(own)).tobytes() + head.tobytes() + raw[spread(begin[own], size[own])].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(shards.astype(np.int32)), pa.array(blobs, pa.binary())], ["shard", "blob"])

    return ids.mapInArrow(run, "shard int, blob binary")


def in_order(blobs: DataFrame, layout: dict, lasts: dict[int, int]) -> DataFrame:
    """The records of each partition's shard, which fits into memory as its
    number of slots is fixed, by slot.  lasts: the slots that are not full, with
    their numbers of ids."""
    width, length = layout["width"], layout["length"]
    stride = length * width

    def run(batches):
        shard, opener = TaskContext.get().partitionId(), zstandard.ZstdDecompressor()
        low = shard * layout["per_shard"]
        n = min(layout["per_shard"], layout["n"] - low)
        rows = np.tile(np.frombuffer(int(layout["end"]).to_bytes(width, "little"), dtype=np.uint8), (n * length, 1))
        filled = np.zeros(n, dtype=np.int64)
        for b in batches:
            for blob in b.column(1):
                raw = opener.decompress(blob.as_py())
                k = int(np.frombuffer(raw, dtype=np.int64, count=1)[0])
                slots, at, size = np.frombuffer(raw, dtype=np.int64, offset=8, count=3 * k).reshape(3, k)
                rows[spread((slots - low) * length + at, size)] = np.frombuffer(raw, dtype=np.uint8, offset=8 + 24 * k).reshape(-1, width)
                np.add.at(filled, slots - low, size)
        want = np.full(n, length)
        for slot, size in lasts.items():
            if low <= slot < low + n:
                want[slot - low] = size
        if not np.array_equal(filled, want):
            raise RuntimeError(f"shard {shard} does not hold each of its slots once")
        rows = rows.reshape(n, stride)
        for lo in range(0, n, 4096):
            part = rows[lo : lo + 4096]
            at = pa.array(np.arange(len(part) + 1, dtype=np.int32) * stride)
            yield pa.RecordBatch.from_arrays([pa.BinaryArray.from_buffers(pa.binary(), len(part), [None, at.buffers()[1], pa.py_buffer(part.tobytes())])], ["record"])

    return blobs.mapInArrow(run, "record binary")


def materialise(ids: DataFrame, path: str, end: int, width: int = 2, key: int = 20240229, length: int = 512, per_shard: int = PER_SHARD):
    """Write the shards under path.  ids: (doc_id, ids), `width` bytes an id.
    Returns the layout and the manifest: one row for each piece of a document,
    with its slot, shard, byte offset, place, size and checksum."""
    spark = ids.sparkSession
    bytes_each = length * width
    ids = stored(placed(ids, width), "ids", **SMALL)
    counts = ids.groupBy("part").agg(F.sum("n").alias("n")).collect()
    bases, ends, n = {}, {}, 0
    for row in sorted(counts, key=lambda r: r.part):
        bases[row.part] = n
        n += -(-row.n // length)
        if row.n % length:
            ends[n - 1] = row.n % length
    layout = {"n": n, "key": key, "length": length, "width": width, "end": end, "per_shard": per_shard, "stride": bytes_each + 1}
    shard, offset = F.expr(f"slot div {per_shard}"), (F.col("slot") % per_shard) * (bytes_each + 1) + F.col("place") * width
    if n:
        lasts = dict(zip(Feistel(n, key).slots(np.array(list(ends), dtype=np.int64)).tolist(), ends.values(), strict=True))
        dealt = shard_blobs(ids, layout, bases).repartitionById(-(-n // per_shard), F.col("shard"))
        in_order(dealt, layout, lasts).select(F.col("record").cast("string").alias("record")).write.option("lineSep", "\n").text(f"{path}/shards")
    spark.createDataFrame([(json.dumps(layout),)], "layout string").coalesce(1).write.text(f"{path}/layout")
    manifest = manifest_rows(ids, layout, bases).select("doc_id", "chunk", "slot", shard.alias("shard"), offset.alias("byte_offset"), "place", "n_tokens", "crc32")
    return layout, manifest


def read_slots(spark: SparkSession, path: str, first: int, count: int) -> list[bytes]:
    """The ids (bytes) of `count` slots from `first` on, by position."""
    layout = json.loads(spark.read.text(f"{path}/layout").first()[0])
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf)
    files = {int(s.getPath().getName().split("-")[1]): s.getPath() for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/shards/part-*"))}
    out, stride = [], layout["stride"]
    while count > 0 and first < layout["n"]:
        shard, at = divmod(first, layout["per_shard"])
        take = min(count, layout["per_shard"] - at, layout["n"] - first)
        stream = fs.open(files[shard])
        stream.seek(at * stride)
        raw = bytes(stream.readNBytes(take * stride))
        stream.close()
        out += [raw[i : i + stride - 1] for i in range(0, len(raw), stride)]
        first, count = first + take, count - take
    return out


def training_order(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """The manifest of the documents' ids, materialised in the shared folder."""
    end = Vocabulary.of(vocabulary_bytes(vocabulary), pattern).end
    return materialise(token_ids(docs, vocabulary, pattern), f"{shared_dir(docs.sparkSession)}/slots-{uuid.uuid4().hex}", end)[1]
