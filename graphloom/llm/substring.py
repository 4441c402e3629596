"""Operator 3: substring dedup with repeated-phrase automata.

A window is `length` consecutive words of one document.  Each word that a
window covers is removed if the window's word sequence also starts in a
document with a smaller doc_id; windows are judged on the input.

1. Every window is given an anchor: the least hash among the five-word
   phrases in it.  Equal windows have equal anchors, and neighbours mostly
   share theirs, so anchors are about a fifth of the words.  Those seen in two
   documents or more are the recurring ones.  Each task combines its own (least
   and greatest doc_id, and how many documents) and sends them packed, column by
   column, a blob for each bucket of anchors.
2. A recurring anchor has a route: its least doc_id, and, if many documents
   have it, one of as many parts as keep a route's documents few.  An anchor of
   very many documents has several routes, by the hash of the window, so that
   equal windows still meet.  A run of windows with one route is a passage.
   Equal passages of a task are sent once, with their least doc_id.
3. Passages are dealt to shards by route.  A shard confirms the recurring
   windows word by word, compiles an Aho-Corasick automaton of them with
   their least doc_id (each distinct word is one letter of its alphabet), and
   streams every passage through it to locate all occurrences.
4. Passages bring what was found back to all their documents.

Hashes only route: a window is removed only after its words were matched, and
none is missed, as equal words have equal hashes.

Edge cases: a null text has no words; a document without windows keeps all
its words; repeated rows of one doc_id, whatever their texts, never delete each
other (only a smaller doc_id counts) and lose each their own words; a null doc_id is neither removed from nor compared; texts of
any length are read whole; extra columns do not matter; empty tables give
empty results.
"""

from __future__ import annotations

import hashlib
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import WordHasher, blocks, grams, long_id, mix, text_bytes

PHRASE = 5
#: Windows that one automaton holds; a shard compiles as many as it needs.
AUTOMATON = 20_000
#: Documents of an anchor for which routes are parted once more, and for which
#: the anchor itself gets one more route.
ROUTE_DOCS, HOT_DOCS = 200, 10_000
#: Anchors that a task holds before it combines and sends them, and bytes of
#: passages that it holds to send equal ones once.
HELD_ANCHORS, HELD_BYTES = 1_000_000, 8_000_000
#: Bytes of text that are hashed at a time.
TEXT_BLOCK = 500_000


def anchors_of(hasher: WordHasher, data, offsets, length: int):
    """Word bounds, and for each window its first word, text and anchor."""
    starts, ends, doc, words = hasher(data, offsets)
    n = len(words) - length + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return starts, ends, doc, none, none.astype(np.uint64)
    phrase = min(PHRASE, length)
    g = grams(words, phrase)
    low = g[:n].copy()
    for i in range(1, length - phrase + 1):
        np.minimum(low, g[i : i + n], out=low)
    at = np.flatnonzero(doc[:n] == doc[length - 1 :])
    # 48 bits are enough for a route and travel lighter
    return starts, ends, doc, at, low[at] >> np.uint64(16)


def packed(texts: DataFrame) -> DataFrame:
    """texts (doc_id, rest, text) with rest, a text, and the text in one
    compressed value, so that each way through an exchange is the same one."""

    def run(batches):
        packer = zstandard.ZstdCompressor(level=3)
        for b in batches:
            rows = (x.as_py().encode() for x in b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([packer.compress(len(x).to_bytes(4, "little") + x + t.as_py()) for x, t in zip(rows, b.column(2), strict=True)], pa.binary())], ["doc_id", "text"])

    return texts.select("doc_id", "rest", "text").mapInArrow(run, "doc_id long, text binary")


def unpacked(batches, rows: int = 250):
    """Batches of at most so many rows; of the last column rest and text."""
    opener = zstandard.ZstdDecompressor()
    for b in batches:
        for i in range(0, b.num_rows, rows):
            part = b.slice(i, rows)
            raw = [opener.decompress(t.as_py()) for t in part.column(part.num_columns - 1)]
            size = [4 + int.from_bytes(x[:4], "little") for x in raw]
            rest, texts = [x[4:n] for x, n in zip(raw, size, strict=True)], [x[n:] for x, n in zip(raw, size, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(rest, pa.binary()), pa.array(texts, pa.binary())], [*part.schema.names[:-1], "rest", "text"])


def combined(anchor, low, high, n):
    """Rows of equal anchors as one, by anchor: least, greatest, number."""
    order = np.argsort(anchor, kind="stable")
    anchor, low, high, n = anchor[order], low[order], high[order], n[order]
    first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    return anchor[first], np.minimum.reduceat(low, first), np.maximum.reduceat(high, first), np.add.reduceat(n, first)


def blob_of(packer, anchor, low, high, n) -> bytes:
    """The rows, sorted by anchor, byte by byte of each column."""
    columns = np.stack([anchor.view(np.int64), low, high - low, n])
    return packer.compress(np.ascontiguousarray(columns.view(np.uint8).reshape(4, -1, 8).transpose(0, 2, 1)).tobytes())


def rows_of(opener, blob: bytes):
    raw = np.frombuffer(opener.decompress(blob), dtype=np.uint8).reshape(4, 8, -1)
    anchor, low, more, n = np.ascontiguousarray(raw.transpose(0, 2, 1)).view(np.int64).reshape(4, -1)
    return anchor.view(np.uint64), low, low + more, n


def anchor_blobs(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """(bucket, blob): anchors with their documents, combined by task."""

    def run(batches):
        hasher, packer, held = WordHasher(), zstandard.ZstdCompressor(level=1), []

        def flush():
            rows = combined(*(np.concatenate(x) for x in zip(*held, strict=True)))
            bucket = (mix(rows[0]) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1]))
            blobs = [blob_of(packer, *(x[order[lo:hi]] for x in rows)) for lo, hi in zip(cuts, [*cuts[1:], len(order)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[order[cuts]]), pa.array(blobs, pa.binary())], ["bucket", "blob"])

        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for row, data, offsets in blocks(b, TEXT_BLOCK):
                _, _, doc, at, low = anchors_of(hasher, data, offsets, length)
                if not len(at):
                    continue
                own = ids[row + doc[at]]
                new = np.ones(len(at), dtype=bool)
                new[1:] = (low[1:] != low[:-1]) | (own[1:] != own[:-1])
                held.append(combined(low[new], own[new], own[new], np.ones(int(new.sum()), dtype=np.int64)))
                if sum(len(x[0]) for x in held) > HELD_ANCHORS:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    return docs.mapInArrow(run, "bucket int, blob binary")


def recurring_anchors(blobs: DataFrame) -> DataFrame:
    """(anchor, route, pieces) of the anchors of two documents or more."""

    def run(batches):
        opener, now, held = zstandard.ZstdDecompressor(), None, []

        def flush():
            anchor, low, high, n = combined(*(np.concatenate(x) for x in zip(*held, strict=True)))
            many = low < high
            anchor, low, n = anchor[many], low[many], n[many]
            part = anchor % (-(-n // ROUTE_DOCS)).astype(np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(mix(mix(low.view(np.uint64)) + part).view(np.int64)), pa.array((-(-n // HOT_DOCS)).astype(np.int32))], ["anchor", "route", "pieces"])

        for b in batches:
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if held and bucket != now:
                    yield flush()
                    held.clear()
                now = bucket
                held.append(rows_of(opener, blob.as_py()))
                if len(held) > 64:  # most of a hot anchor's rows are one by now
                    held[:] = [combined(*(np.concatenate(x) for x in zip(*held, strict=True)))]
        if held:
            yield flush()

    return blobs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "anchor long, route long, pieces int")


def doc_anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, anchor): the distinct anchors of each document."""

    def run(batches):
        hasher = WordHasher()
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for row, data, offsets in blocks(b, TEXT_BLOCK):
                _, _, doc, at, low = anchors_of(hasher, data, offsets, length)
                if not len(at):
                    continue
                own = row + doc[at]
                order = np.lexsort((low, own))
                low, own = low[order], own[order]
                new = np.append(True, (low[1:] != low[:-1]) | (own[1:] != own[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[own[new]]), pa.array(low[new].view(np.int64))], ["doc_id", "anchor"])

    return docs.mapInArrow(run, "doc_id long, anchor long")


def passages_of(hasher: WordHasher, batch, length: int):
    """Passages of a batch (doc_id, anchors: route and pieces of each, text):
    (route, doc_id, the text's CRC, first word, words, bytes), block by block."""
    ids, known = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    for row, data, offsets in blocks(batch, TEXT_BLOCK):
        starts, ends, doc, at, low = anchors_of(hasher, data, offsets, length)
        low, exact = low.view(np.int64), None
        cuts = np.searchsorted(doc[at], np.arange(len(offsets)))
        firsts = np.searchsorted(doc, np.arange(len(offsets)))
        raw = data.tobytes()
        for i in range(len(offsets) - 1):
            lo, hi = cuts[i], cuts[i + 1]
            if lo == hi:
                continue
            anchors, routes, pieces = (x.to_numpy(zero_copy_only=False) for x in known[row + i].values.flatten())
            order = np.argsort(anchors)
            anchors, routes, pieces = anchors[order], routes[order], pieces[order]
            k = np.minimum(np.searchsorted(anchors, low[lo:hi]), len(anchors) - 1)
            hit, own, parts = anchors[k] == low[lo:hi], routes[k], pieces[k]
            if (hot := np.flatnonzero(parts > 1)).size:
                if exact is None:
                    _, _, _, words = hasher(data, offsets)
                    exact = grams(words, length)
                own[hot] = mix(own[hot].view(np.uint64) + np.uint64(1) + exact[at[lo:hi][hot]] % parts[hot].astype(np.uint64)).view(np.int64)
            crc = zlib.crc32(data[offsets[i] : offsets[i + 1]])
            turn = np.append(True, own[1:] != own[:-1])
            begin = np.flatnonzero(hit & (turn | np.append(True, ~hit[:-1])))
            end = np.flatnonzero(hit & (np.append(turn[1:], True) | np.append(~hit[1:], True)))
            for x, y in zip(begin.tolist(), end.tolist(), strict=True):
                w, last = at[lo + x], at[lo + y] + length - 1
                yield own[x], ids[row + i], crc, w - firsts[i], last - w + 1, b" ".join(raw[starts[w] : ends[last]].split())


def passage_places(candidates: DataFrame, length: int) -> DataFrame:
    """(route, mark, doc_id, crc, start, size): where each document has
    passages; mark is the MD5 of a passage's words."""
    kinds, names = [pa.int64(), pa.binary(), *[pa.int64()] * 4], ["route", "mark", "doc_id", "crc", "start", "size"]

    def run(batches):
        hasher = WordHasher()
        for b in unpacked(batches):
            rows = [(route, hashlib.md5(said).digest(), doc, crc, at, size) for route, doc, crc, at, size, said in passages_of(hasher, b, length)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return candidates.select("doc_id", "anchors", "text").mapInArrow(run, "route long, mark binary, doc_id long, crc long, start long, size long")


def passage_words(candidates: DataFrame, length: int) -> DataFrame:
    """(route, mark, doc_id, words): passages with their least doc_id; equal
    ones that a task holds at a time are one row."""

    def run(batches):
        hasher, held, size = WordHasher(), {}, 0

        def flush():
            (routes, marks), (docs, said) = zip(*held, strict=True), zip(*held.values(), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(routes, pa.int64()), pa.array(marks, pa.binary()), pa.array(docs, pa.int64()), pa.array(said, pa.binary())], ["route", "mark", "doc_id", "words"])

        for b in unpacked(batches):
            for route, doc, _, _, _, said in passages_of(hasher, b, length):
                key = (route, hashlib.md5(said).digest())
                before = held.get(key)
                if before is None:
                    size += len(said)
                    held[key] = (doc, said)
                elif doc < before[0]:
                    held[key] = (doc, before[1])
            if size > HELD_BYTES:
                yield flush()
                held, size = {}, 0
        if held:
            yield flush()

    return candidates.select("doc_id", "anchors", "text").mapInArrow(run, "route long, mark binary, doc_id long, words binary")


def locate(rows: list[tuple], length: int):
    """rows: (route, words, least doc_id) of all passages of some routes.
    Yields, for each, the numbers of the windows whose words also start in a
    document with a smaller doc_id than the passage's least one."""
    letters: dict[bytes, str] = {}
    said = []
    for _, words, _ in rows:
        own = []
        for w in words.split():
            c = letters.get(w)
            if c is None:
                n = len(letters) + 1
                c = letters[w] = chr(n if n < 0xD800 else n + 0x800)
            own.append(c)
        said.append("".join(own))
    least: dict[str, int] = {}
    recurs: set[str] = set()
    for (_, _, doc), text in zip(rows, said, strict=True):
        for i in range(len(text) - length + 1):
            w = text[i : i + length]
            before = least.setdefault(w, doc)
            if before != doc:
                recurs.add(w)
                if doc < before:
                    least[w] = doc
    machine = ahocorasick.Automaton()
    for w in recurs:
        machine.add_word(w, least[w])
    if recurs:
        machine.make_automaton()
    for (_, _, doc), text in zip(rows, said, strict=True):
        yield [end - length + 1 for end, first in machine.iter(text) if first < doc] if recurs else []


def located(passages: DataFrame, length: int) -> DataFrame:
    """One row per distinct passage (route, mark, doc_id, words): its least
    doc_id and its windows that were found in a document before that one."""
    dealt = passages.repartition("route").sortWithinPartitions("route", "mark", "doc_id")

    def run(batches):
        held: list[tuple] = []
        windows = 0

        def flush():
            out = list(locate([(h[0], h[3], h[2]) for h in held], length))
            return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.binary()), pa.array([h[2] for h in held], pa.int64()), pa.array(out, pa.list_(pa.int32()))], ["route", "mark", "first_doc", "found"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and held[-1][:2] == row[:2]:
                    continue  # the same words from another task, a later document
                if windows > AUTOMATON and held[-1][0] != row[0]:
                    yield flush()
                    held, windows = [], 0
                held.append(row)
                windows += max(1, row[3].count(b" ") + 2 - length)
        if held:
            yield flush()

    return dealt.mapInArrow(run, "route long, mark binary, first_doc long, found array<int>")


def covered_words(texts: DataFrame, bundle: DataFrame, length: int = 13) -> DataFrame:
    """(doc_id, spans): what to remove, as start and end word of each piece.
    texts: doc_id (not null), text as bytes."""
    buckets = 4 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    recurring = recurring_anchors(anchor_blobs(texts, length, buckets))
    anchors = doc_anchor_rows(texts, length).join(recurring, "anchor").groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "route", "pieces")).alias("anchors"))
    candidates = anchors.join(bundle, "doc_id").select("doc_id", "anchors", "text")
    found = located(passage_words(candidates, length), length)
    back = passage_places(candidates, length).join(found, ["route", "mark"])
    whole = F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("size")).alias("b"), "crc"))
    some = F.transform("found", lambda i: F.struct((F.col("start") + i).alias("a"), (F.col("start") + i + length).alias("b"), F.col("crc").alias("crc")))
    spans = back.select("doc_id", F.when(F.col("doc_id") > F.col("first_doc"), whole).otherwise(some).alias("spans")).where(F.size("spans") > 0)
    return spans.groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def without_repeats(docs: DataFrame, length: int = 13, as_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256, the SHA-256 of the kept words;
    or, with as_text, all columns of docs, text without the words that go (a
    text that loses none as it is), and n_words and n_removed as __n_words and
    __n_removed."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")] if as_text else []
    # a null text is told from an empty one by its rest
    held = F.to_json(F.struct(*(F.col(f"`{c}`") for c in rest), F.col("text").isNull().alias("__null"))) if as_text else F.lit("")
    all_texts = text_bytes(docs.select(long_id(docs), held.alias("rest"), "text"), "doc_id", "rest")
    # one and the same exchange of the texts serves both joins
    texts = all_texts.where("doc_id IS NOT NULL")
    bundle = packed(texts)
    both = bundle.join(covered_words(texts.select("doc_id", "text"), bundle, length), "doc_id", "left").select("doc_id", "spans", "text")
    none = F.lit(None).cast(both.schema["spans"].dataType)
    both = both.unionByName(packed(all_texts.where("doc_id IS NULL")).select("doc_id", none.alias("spans"), "text"))
    name = "text" if as_text else "kept_sha256"

    def run(batches):
        for part in unpacked(batches):
            total, gone, kept = [], [], []
            for spans, text in zip(part.column(1).to_pylist(), part.column(3).to_pylist(), strict=True):
                words = every = text.split()
                total.append(len(words))
                if spans:
                    crc = zlib.crc32(text)  # rows of one doc_id may have different texts
                    keep = np.zeros(len(words) + 1, dtype=np.int64)
                    for at, sign in (("a", 1), ("b", -1)):
                        np.add.at(keep, [s[at] for s in spans if s["crc"] == crc], sign)
                    keep = np.cumsum(keep)[:-1] == 0
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                gone.append(total[-1] - len(words))
                if as_text:
                    kept.append((text if len(words) == len(every) else b" ".join(words)).decode("utf-8", "replace"))
                else:
                    kept.append(hashlib.sha256(b" ".join(words)).hexdigest())
            columns = [part.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [part.column(2).cast(pa.string())] * as_text, ["doc_id", "n_words", "n_removed", name] + ["rest"] * as_text)

    out = both.mapInArrow(run, f"doc_id long, n_words long, n_removed long, {name} string" + ", rest string" * as_text)
    if not as_text:
        return out
    own = out.withColumn("rest", F.from_json("rest", f"struct<{', '.join(f'`{c}`:{docs.schema[c].dataType.simpleString()}' for c in rest)}{',' if rest else ''}`__null`:boolean>"))
    text = F.when(~F.col("rest.__null"), F.col("text"))
    values = {"doc_id": F.col("doc_id"), "text": text.alias("text")} | {c: F.col(f"rest.`{c}`").alias(c) for c in rest}
    return own.select(*(values[c] for c in docs.columns), F.col("n_words").alias("__n_words"), F.col("n_removed").alias("__n_removed"))
