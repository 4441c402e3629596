"""Operator 4: language identification by multinomial naive Bayes.

Features are character n-grams (n = 1 to 4) of the whole lower-cased text,
hashed into 2**15 bins, for texts of any length in blocks.  Training sums
counts in every task, then by language and salt and then by language, so that a
language that most documents have is added up in many tasks.  The matrix of log
probabilities is broadcast; its size is bounded by `MOST_CELLS`, and more
languages than fit (512) are an error, which asks for fewer `bits`.  The counts
reach the driver as one vector a language (128 MB at most, in 64 bits).
A text's score is the product of one sparse batch and the matrix, by gather
and segment sums in numpy.

Edge cases: a null text, or one without a letter, is `und` with score 0; with
no labelled row every text is `und`; ties go to the language that sorts first;
null langs and null doc_ids are not learnt from; repeated rows count as often
as they occur; extra columns do not matter; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import mix, stored

BITS, LONGEST = 15, 4
#: Parts in which the count vectors of one language are added up first.
SALTS = 64
#: Cells of the broadcast matrix at most: 64 MB of 32-bit floats.
MOST_CELLS = 1 << 24
LETTER = regex.compile(r"\p{L}")


def text_grams(texts: list[str], bits: int):
    """Bins of all n-grams of all texts, and for each n the text bounds."""
    long = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(long)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    h = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, LONGEST + 1):
        m = len(codes) - n + 1
        if m <= 0:
            return
        h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
        bins = (mix(h) >> np.uint64(64 - bits)).astype(np.int32)
        # grams that cross into the next text belong to none
        first = np.minimum(ends - long, m)
        yield bins, first, np.minimum(np.maximum(ends - n + 1, ends - long), m)


def pieces(texts: list[str], most: int = 1_000_000):
    """Runs of texts of at most about `most` characters."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= most):
            size += len(texts[j])
            j += 1
        yield i, texts[i:j]
        i = j


def count_grams(rows: DataFrame, bits: int) -> DataFrame:
    """rows: lang, text -> (lang, n, counts): one row per task and language."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for b in batches:
            langs, texts = b.column(0).to_pylist(), [t.decode("utf-8", "replace").lower() for t in b.column(1).to_pylist()]
            order = sorted(range(len(langs)), key=langs.__getitem__)
            at = 0
            while at < len(order):
                lang, own = langs[order[at]], []
                while at < len(order) and langs[order[at]] == lang:
                    own.append(texts[order[at]])
                    at += 1
                sums = total.setdefault(lang, np.zeros(1 << bits, dtype=np.int64))
                seen[lang] = seen.get(lang, 0) + len(own)
                for _, some in pieces(own):
                    for bins, first, last in text_grams(some, bits):
                        inside = np.zeros(len(bins) + 1, dtype=np.int32)
                        np.add.at(inside, first, 1)
                        np.add.at(inside, last, -1)
                        sums += np.bincount(bins[np.cumsum(inside)[:-1] > 0], minlength=1 << bits)
            if len(total) << bits > MOST_CELLS // 2:
                yield rows_of(total, seen)
                total, seen = {}, {}
        if total:
            yield rows_of(total, seen)

    def rows_of(total, seen):
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([seen[k] for k in total], pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["lang", "n", "counts"])

    return rows.select("lang", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")).mapInArrow(run, "lang string, n long, counts binary")


def sum_counts(counts: DataFrame) -> DataFrame:
    """Add the count vectors of each language: by salt, then all."""
    fields = "lang string, n long, counts binary"

    def add(batches):
        total: dict[str, list] = {}
        for b in batches:
            for lang, n, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = total.setdefault(lang, [0, 0])
                own[0] += n
                own[1] = own[1] + np.frombuffer(raw, dtype=np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v[0] for v in total.values()], pa.int64()), pa.array([v[1].tobytes() for v in total.values()], pa.binary())], ["lang", "n", "counts"])

    salt = F.pmod(F.xxhash64("counts"), F.lit(SALTS))
    return counts.repartition("lang", salt).mapInArrow(add, fields).repartition("lang").mapInArrow(add, fields)


def train(docs: DataFrame, smoothing: float = 0.5, bits: int = BITS):
    """Languages, bits, and the log probabilities (bins x languages)."""
    usable = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    n_langs = usable.select("lang").distinct().count()
    if n_langs << bits > MOST_CELLS:
        raise ValueError(f"{n_langs} languages in 2**{bits} bins are over {MOST_CELLS} cells; use fewer bits")
    rows = sorted(stored(sum_counts(count_grams(usable, bits)), "counts").collect(), key=lambda r: r.lang)
    if not rows:
        return [], bits, np.zeros((1 << bits, 0), np.float32), np.zeros(0)
    counts = np.stack([np.frombuffer(r.counts, dtype=np.int64) for r in rows], axis=1).astype(float) + smoothing
    prior = np.array([r.n for r in rows], dtype=float)
    return [r.lang for r in rows], bits, np.log(counts / counts.sum(axis=0)).astype(np.float32), np.log(prior / prior.sum())


def predict(docs: DataFrame, model) -> DataFrame:
    """doc_id -> lang_pred and score, for every row."""
    langs, bits, logs, prior = model
    sent = docs.sparkSession.sparkContext.broadcast((langs, logs, prior))

    def run(batches):
        langs, logs, prior = sent.value
        for b in batches:
            texts = [t.decode("utf-8", "replace") for t in b.column(1).to_pylist()]
            said, score = [], []
            for _, some in pieces(texts):
                total = np.tile(prior, (len(some), 1)) if langs else np.zeros((len(some), 1))
                if langs:
                    for bins, first, last in text_grams([t.lower() for t in some], bits):
                        for k in range(len(langs)):
                            sums = np.zeros(len(bins) + 1)
                            np.cumsum(logs[bins, k], dtype=float, out=sums[1:])
                            total[:, k] += sums[last] - sums[first]
                best = total.argmax(axis=1)
                sure = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                for t, k, s in zip(some, best.tolist(), sure.tolist(), strict=True):
                    known = bool(langs) and LETTER.search(t) is not None
                    said.append(langs[k] if known else "und")
                    score.append(s if known else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(said, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    return own.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Train on the documents' own labelled part, then predict every row."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return predict(docs, train(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
