"""Operator 9: quality classifier as a sparse rule ensemble.

Shallow boosted trees over text statistics are grown on a bounded, documented
sample of labelled rows (at most `most_rows`, those of least hash); every path
from a root to a node is a conjunctive rule; a lasso logistic regression keeps
few of them; and the kept rules become one Spark column expression over the
statistics.  Statistics are computed of every whole text, in numpy blocks.

Edge cases: null and empty texts have zero statistics and get a score as any
other; without labels of both kinds every score is the labels' mean (0.5 if
there are none); repeated labels of a document count once (the least one);
null labels and null doc_ids are not learnt from; ties in the sample's hash
break by doc_id; extra columns are kept or ignored; empty tables give empty
results.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import WordHasher, mix

STATS = ["words", "bytes", "word_bytes", "upper", "shouted", "symbols", "bangs", "bars", "digits", "high", "marked", "stops", "again", "lines", "line_words", "spread"]
#: The added column of statistics.
HELD = "__quality_stats"
#: Bytes of text that are measured at a time.
TEXT_BLOCK = 300_000


def byte_classes() -> np.ndarray:
    """For each byte value, one row of flags: upper-case, lower-case, symbol,
    exclamation mark, bar, digit, beyond ASCII, sentence mark, line feed."""
    out = np.zeros((9, 256), dtype=np.uint8)
    out[0, 65:91] = out[1, 97:123] = out[5, 48:58] = out[6, 128:] = 1
    out[2, [ord(c) for c in "#$%&*+<>=@\\^_`{}~/[]|"]] = 1
    out[3, ord("!")] = out[4, ord("|")] = out[8, 10] = 1
    out[7, [ord(c) for c in ".,;:?"]] = 1
    return out


def block_stats(hasher: WordHasher, classes: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATS for each text of a block."""
    n = len(offsets) - 1
    starts, ends, doc, words = hasher(data, offsets)
    size = np.diff(offsets).astype(float)
    count = np.bincount(doc, minlength=n).astype(float)
    sums = np.zeros((9, n))
    ups = np.zeros(len(data) + 1, dtype=np.int64)
    lows = np.zeros(len(data) + 1, dtype=np.int64)
    for k in range(9):
        total = ups if k == 0 else lows if k == 1 else np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(classes[k][data], out=total[1:])
        sums[k] = total[offsets[1:]] - total[offsets[:-1]]
    per_word = lambda flags: np.bincount(doc, weights=flags, minlength=n)
    shouted = (ups[ends] - ups[starts] >= 2) & (lows[ends] == lows[starts])
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    marked = classes[2][last] | classes[3][last]
    stops = classes[7][last]
    again = np.zeros(len(words))
    again[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    own = mix(words + mix(doc.astype(np.uint64)))  # a text's word, told from other texts'
    order = np.argsort(own)
    fresh = np.append(True, own[order][1:] != own[order][:-1]) if len(own) else np.zeros(0)
    distinct = np.bincount(doc[order], weights=fresh, minlength=n)
    some, letters, any_bytes = np.maximum(count, 1), np.maximum(sums[0] + sums[1], 1), np.maximum(size, 1)
    solid = np.bincount(doc, weights=ends - starts, minlength=n)
    return np.column_stack([
        np.log1p(count), np.log1p(size), solid / some, sums[0] / letters, per_word(shouted) / some, sums[2] / any_bytes, sums[3] / any_bytes, sums[4] / any_bytes, sums[5] / any_bytes,
        sums[6] / any_bytes, per_word(marked) / some, per_word(stops) / some, per_word(again) / some, np.log1p(sums[8]), count / (sums[8] + 1), distinct / some,
    ])


def text_stats(texts: pd.Series) -> pd.DataFrame:
    hasher, classes, out = WordHasher(), byte_classes(), []
    values = texts.tolist()
    i = 0
    while i < len(values):
        j, size = i, 0
        while j < len(values) and (j == i or size + len(values[j]) <= TEXT_BLOCK):
            size += len(values[j])
            j += 1
        part = values[i:j]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in part])]).astype(np.int64)
        out.append(block_stats(hasher, classes, np.frombuffer(b"".join(part), dtype=np.uint8), offsets))
        i = j
    return pd.DataFrame(np.concatenate(out) if out else np.zeros((0, len(STATS))), columns=STATS)


def with_stats(docs: DataFrame, name: str = HELD) -> DataFrame:
    measured = F.pandas_udf(text_stats, ", ".join(f"{s} double" for s in STATS))
    return docs.withColumn(name, measured(F.coalesce(F.col("text").cast("binary"), F.lit(b""))))


# ----------------------------------------------------------------- learning


def grow(binned: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, least: int):
    """One regression tree on histograms.  Returns its rules, each a tuple of
    (feature, cut, above), and the value that it adds to every row."""
    add, rules = np.zeros(len(grad)), []

    def node(rows: np.ndarray, path: tuple) -> None:
        if path:
            rules.append(path)
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-6, None, None)
        if len(path) < depth and len(rows) >= 2 * least:
            for f in range(binned.shape[1]):
                size = len(cuts[f]) + 1
                if size < 2:
                    continue
                b = binned[rows, f]
                gs, hs, ns = (np.cumsum(np.bincount(b, weights=x, minlength=size))[:-1] for x in (grad[rows], hess[rows], np.ones(len(rows))))
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                gain[(ns < least) | (len(rows) - ns < least)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
        _, f, k = best
        if f is None:
            add[rows] = -g / (h + 1)
            return
        left = binned[rows, f] <= k
        node(rows[left], (*path, (f, float(cuts[f][k]), False)))
        node(rows[~left], (*path, (f, float(cuts[f][k]), True)))

    node(np.arange(len(grad)), ())
    return rules, add


def holds(rule: tuple, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for f, cut, above in rule:
        out &= (x[:, f] > cut) == above
    return out


def learn_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 5e-4):
    """(intercept, [(weight, rule)]): boosted paths, thinned by the lasso."""
    if not len(y):
        return 0.0, []
    mean = y.mean()
    if mean in (0, 1):
        return float(np.log((mean * len(y) + 0.5) / (len(y) - mean * len(y) + 0.5))), []
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 49))) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    score, rules = np.full(len(y), np.log(mean / (1 - mean))), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        found, add = grow(binned, cuts, p - y, p * (1 - p), depth, max(5, len(y) // 500))
        score += 0.3 * add
        rules += found
    columns: dict[bytes, tuple] = {}
    for r in rules:
        columns.setdefault(np.packbits(holds(r, x)).tobytes(), r)
    rules = list(columns.values())
    a = np.column_stack([holds(r, x) for r in rules]).astype(np.float32)
    scale = np.sqrt(np.maximum(a.mean(0) * (1 - a.mean(0)), 1e-6)).astype(np.float32)
    # accelerated proximal gradient on standardised rules, free intercept
    a = (a - a.mean(0)) / scale
    center = np.array([holds(r, x).mean() for r in rules])
    step = 4 / float(np.linalg.norm(a.T @ a / len(y), 2) + 1)
    w = v = np.zeros(len(rules))
    b = c = float(np.log(mean / (1 - mean)))
    t = 1.0
    for _ in range(400):
        err = (1 / (1 + np.exp(-(a @ v.astype(np.float32) + c))) - y).astype(np.float32)
        new = v - step * (a.T @ err / len(y))
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        nb, nt = c - step * float(err.mean()), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    weights = w / scale
    return float(b - (weights * center).sum()), [(float(weights[i]), rules[i]) for i in kept]


def score_column(model, stats: str = HELD) -> Column:
    """The rules as one column expression: a probability."""
    base, rules = model
    total = F.lit(float(base))
    for weight, rule in rules:
        tests = [F.col(f"{stats}.{STATS[f]}") > cut if above else F.col(f"{stats}.{STATS[f]}") <= cut for f, cut, above in rule]
        total = total + F.when(reduce(lambda p, q: p & q, tests), float(weight)).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000):
    """Learn from labelled rows whose crc32(doc_id) mod 5 is not 0, at most
    most_rows of them.  The sample's ids (160 KB) may be broadcast."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL").where(remainder(5) != 0)
    sample = usable.groupBy("doc_id").agg(F.min("quality").alias("__label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    rows = with_stats(own).select("__label", f"{HELD}.*").limit(2 * most_rows).toPandas().sort_values(["__label", *STATS])
    return learn_rules(rows[STATS].to_numpy(dtype=float), (rows["__label"].to_numpy() > 0).astype(float))


def scored(docs: DataFrame, model) -> DataFrame:
    """docs with the column score, in one pass over the texts."""
    return with_stats(docs).withColumn("score", score_column(model)).drop(HELD)


def quality_scores(docs: DataFrame, labels: DataFrame, bar: float = 0.3) -> DataFrame:
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = scored(own, train(docs, labels))
    return out.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= bar).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, bar: float = 0.3) -> DataFrame:
    """Those rows of docs, unchanged, that score at least bar."""
    model, name = train(docs, labels), HELD
    while name in docs.columns:
        name += "_"
    return with_stats(docs, name).where(score_column(model, name) >= bar).drop(name)
