"""Operator 8: BPE encoding and decoding with a segment tree.

The tokenizer file (a parameter) is read on the driver and broadcast; its
size is checked against `MOST_BYTES`.  Each white-space-free piece of text is
encoded once for many texts and remembered in a dictionary of bounded size.

Edge cases: a null text counts as empty; an empty text has no tokens and the
hashes of the empty string; texts and pieces of any length are encoded whole
(the tree makes that n log n); repeated rows give repeated rows; extra columns
do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import give_back, text_bytes

#: A tokenizer file above this size is refused, as it is broadcast.
MOST_BYTES = 64 << 20
#: Pieces that a task remembers before it starts afresh.
REMEMBERED = 150_000
NONE = 1 << 62


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(spare)
            spare += 1
    return [out[b] for b in range(256)]


class Encoder:
    """A word-end BPE as the given tokenizers file describes it."""

    def __init__(self, spec: str) -> None:
        spec = json.loads(spec)
        vocab = spec["model"]["vocab"]
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.names = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.names |= {i: t for t, i in self.special.items()}
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + suffix] for c in letters]
        #: pair of ids -> rank * 2**32 + new id; a pair is a * 2**20 + b
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(vocab[a] << 20 | vocab[b], (rank, vocab[a + b]))
        keys = np.array(list(self.merges), dtype=np.int64)
        order = np.argsort(keys)
        self.pairs = np.append(keys[order], NONE)
        self.ranks = np.append(np.array([r for r, _ in self.merges.values()], dtype=np.int64)[order], 0)
        self.made = np.zeros(len(spec["model"]["merges"]) + 1, dtype=np.int64)
        for rank, new in self.merges.values():
            self.made[rank] = new
        self.first, self.last = np.array(self.inner), np.array(self.final)
        self.digits = {i: str(i) for i in self.names}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"])
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.odd = regex.compile("[\x1c-\x1f]")
        self.space = regex.compile(r"\s+")
        self.known: dict[str, tuple] = {}

    def merge(self, ids: list[int]) -> list[int]:
        """Merge until no pair is left.

        The tree's leaf i holds rank * 2**32 + i of the pair that begins at
        symbol i, an inner node the least of its two; so the root is the
        leftmost pair of the lowest rank, and a merge updates three leaves.
        """
        n = len(ids)
        if n < 2:
            return ids
        merges, size = self.merges, 1 << (n - 2).bit_length() if n > 2 else 1
        tree = [NONE] * (2 * size)
        for i in range(n - 1):
            if found := merges.get(ids[i] << 20 | ids[i + 1]):
                tree[size + i] = found[0] << 32 | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        if tree[1] == NONE:
            return ids
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        while (top := tree[1]) != NONE:
            i = top & 0xFFFFFFFF
            j = after[i]
            ids[i] = new = merges[ids[i] << 20 | ids[j]][1]
            ids[j] = -1
            k = after[i] = after[j]
            fresh = [(i, NONE)]
            if k >= 0:
                before[k] = i
                if found := merges.get(new << 20 | ids[k]):
                    fresh[0] = (i, found[0] << 32 | i)
                fresh.append((j, NONE))
            elif j < n - 1:
                fresh.append((j, NONE))
            if (h := before[i]) >= 0:
                found = merges.get(ids[h] << 20 | new)
                fresh.append((h, found[0] << 32 | h if found else NONE))
            for x, v in fresh:
                x += size
                if tree[x] == v:
                    continue
                tree[x] = v
                while x > 1:
                    o = tree[x ^ 1]
                    if o < v:
                        v = o
                    x >>= 1
                    if tree[x] == v:
                        break
                    tree[x] = v
        return [x for x in ids if x >= 0]

    def leaves(self, pair: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaf values of pairs that begin at the given symbols."""
        k = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[k] == pair, self.ranks[k] << 32 | at, NONE)

    def merge_many(self, words: list[bytes]) -> list[list[int]]:
        """merge() for many words at once: one tree a word, of equal size,
        as the rows of an array; each step merges in every unfinished row."""
        out: list = [None] * len(words)
        sized: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            n = len(w)
            if n > 65:
                ids = [self.inner[b] for b in w]
                ids[-1] = self.final[w[-1]]
                out[i] = self.merge(ids)
            else:
                sized.setdefault(1 << max(n - 2, 0).bit_length(), []).append(i)
        for size, members in sized.items():
            for lo in range(0, len(members), 16384):
                own = members[lo : lo + 16384]
                for i, ids in zip(own, self.lockstep([words[i] for i in own], size), strict=True):
                    out[i] = ids
        return out

    def lockstep(self, words: list[bytes], size: int) -> list[list[int]]:
        rows, long = len(words), np.array([len(w) for w in words])
        ends = np.cumsum(long)
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        flat = self.first[raw]
        flat[ends - 1] = self.last[raw[ends - 1]]
        gone = 1 << 19  # in no pair; the column after each word's last symbol
        ids = np.full((rows, size + 3), gone, dtype=np.int64)
        ids[np.repeat(np.arange(rows), long), np.arange(len(raw)) - np.repeat(ends - long, long)] = flat
        after = np.minimum(np.arange(1, size + 4), size + 2) + np.zeros((rows, 1), dtype=np.int64)
        before = np.arange(-1, size + 2) + np.zeros((rows, 1), dtype=np.int64)
        tree = np.full((rows, 2 * size), NONE, dtype=np.int64)
        tree[:, size:] = self.leaves(ids[:, :size] << 20 | ids[:, 1 : size + 1], np.arange(size))
        step = size
        while step > 1:
            half = step // 2
            tree[:, half:step] = np.minimum(tree[:, step : 2 * step : 2], tree[:, step + 1 : 2 * step : 2])
            step = half
        r = np.arange(rows)
        while True:
            top = tree[r, 1]
            r = r[top != NONE]
            if not len(r):
                break
            top = top[top != NONE]
            i, new = top & 0xFFFFFFFF, self.made[top >> 32]
            j = after[r, i]
            k = after[r, j]
            h = before[r, i]
            ids[r, i], ids[r, j] = new, gone
            after[r, i], before[r, k] = k, i
            changed = [(i, self.leaves(new << 20 | ids[r, k], i)), (j, np.full(len(r), NONE)), (h, self.leaves(ids[r, np.maximum(h, 0)] << 20 | new, h))]
            for at, value in changed:
                ok = (at >= 0) & (at < size)
                x, s = size + at[ok], r[ok]
                tree[s, x] = value[ok]
                while size > 1 and len(x):
                    x = x >> 1
                    tree[s, x] = np.minimum(tree[s, 2 * x], tree[s, 2 * x + 1])
                    if x[0] == 1:
                        break
        left = ids != gone
        counts, kept = left.sum(axis=1), ids[left].tolist()
        out, at = [], 0
        for c in counts.tolist():
            out.append(kept[at : at + c])
            at += c
        return out

    def parts(self, chunk: str) -> list:
        """A piece of text without white space as words (bytes) and the ids
        of special tokens, which are looked for before anything else."""
        special = self.marks is not None and "<" in chunk
        out: list = []
        for x in self.marks.split(chunk) if special else (chunk,):
            if x in self.special:
                out.append(self.special[x])
            elif x:
                if not x.isascii():
                    x = unicodedata.normalize("NFC", x).replace("Σ", "σ")
                x = x.lower()
                words = (x,) if x.isascii() and x.isalpha() else self.pieces.findall(x)
                out += [w.encode("utf-8", "surrogatepass") for w in words]
        return out

    def learn(self, chunks: set[str]) -> dict[str, tuple]:
        """For each piece: its ids and their tokens, both as text (ids as
        lists of numbers take more memory)."""
        parts = {c: self.parts(c) for c in chunks}
        words = list({w for p in parts.values() for w in p if isinstance(w, bytes)})
        ids = dict(zip(words, self.merge_many(words), strict=True))
        out, digits, names = {}, self.digits, self.names
        for c, p in parts.items():
            own = [i for w in p for i in (ids[w] if isinstance(w, bytes) else (w,))]
            out[c] = (" ".join([digits[i] for i in own]), " ".join([names[i] for i in own]))
        return out

    def split(self, text: str) -> list[str]:
        return [x for x in self.space.split(text) if x] if self.odd.search(text) else text.split()

    def looked_up(self, texts: list[str]):
        """The pieces' entries of each text; new pieces are learnt together."""
        split = [self.split(t) for t in texts]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        fresh = {x for s in split for x in s}
        fresh.difference_update(known)
        known.update(self.learn(fresh))
        for s in split:
            yield [h for x in s if (h := known[x])[0]]

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        return [[int(i) for h in found for i in h[0].split(" ")] for found in self.looked_up(texts)]

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0]

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so tokens are joined by spaces."""
        return " ".join(map(self.names.__getitem__, ids))

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of ids, SHA-256 of the ids and of the decoded text."""
        out = []
        for found in self.looked_up(texts):
            ids = " ".join([h[0] for h in found]).encode()
            said = " ".join([h[1] for h in found]).encode("utf-8", "surrogatepass")
            out.append((ids.count(b" ") + bool(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(said).hexdigest()))
        return out


def tokenizer_spec(path: str) -> str:
    """The file's content, checked against the size that may be broadcast."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    if len(spec) > MOST_BYTES:
        raise ValueError(f"{path} has over {MOST_BYTES} bytes")
    return spec


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids, decoded): the operator's real output."""
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_spec(path))

    def run(batches):
        enc = Encoder(spec.value)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                ids = enc.encode_many([t.decode("utf-8", "replace") for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([enc.decode(x) for x in ids], pa.string())], ["doc_id", "n_tokens", "token_ids", "decoded"])

    return text_bytes(docs, "doc_id").mapInArrow(run, "doc_id long, n_tokens long, token_ids array<int>, decoded string")


def decode_tokens(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, token_ids) -> (doc_id, decoded)."""
    spec = tokens.sparkSession.sparkContext.broadcast(tokenizer_spec(path))

    def run(batches):
        enc = Encoder(spec.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "decoded"])

    return tokens.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, decoded string")


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """Number and hashes of each text's ids and decoded text, one pass."""
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_spec(path))

    def run(batches):
        give_back()
        enc = Encoder(spec.value)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                rows = enc.digests([t.decode("utf-8", "replace") for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return text_bytes(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
