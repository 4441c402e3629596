"""Operator 5: mixing sources to target weights by entropy balancing.

Sizes are words.  A source's target is its weight's share of all words, at
most `most` times its own size, the excess going to the others by weight.
Rates are those nearest to 1 in relative entropy that meet every source's
token constraint with none above `most`: exp(lambda * size), cut at `most`.
The dual is convex and splits by source; Newton's method, kept in a bracket,
starts from a histogram of sizes and goes on with exact sums over all documents
until every source meets its target (an error if it does not in `MOST_PASSES`).
Rates become whole copies by error diffusion from the longest
document to the shortest in groups of bounded size, so a source's words miss
its target by about the size of a few of its shortest documents.

Edge cases: a null text has size 0; a document of size 0 takes nothing and
stays once; a null source is a source of its own and comes last; repeated rows
are documents of their own; null doc_ids are kept; sources without words have
target 0; extra columns do not matter; an empty table gives an empty result.
Reruns agree: all choices are by size and doc_id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import stored

#: Documents that one rounding group holds on average.
GROUP = 4_000
#: Exact Newton or bisection passes, and the relative error that ends them.
MOST_PASSES, CLOSE = 100, 1e-9
WORD = r"[^\x20\x09-\x0D]+"


def source_key():
    """The source as a text that is never null."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def sized(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"))


def source_targets(sizes: DataFrame, most: float) -> DataFrame:
    """(key, source_size, n_docs, target): one row a source."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = stored(by_source.select(source_key().alias("key"), "source_size", "n_docs", (place % 3 + 1).cast("double").alias("weight"), (F.col("source_size") * float(most)).alias("cap")), "sources")
    total, level = float(weighed.agg(F.sum("source_size")).first()[0] or 0), 0.0
    while True:
        full = F.col("weight") * level >= F.col("cap")
        caps, weights = weighed.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        new = (total - caps) / weights if weights else level
        if not weights or new <= level * (1 + 1e-15):
            break
        level = new
    return weighed.select("key", "source_size", "n_docs", F.least(F.col("weight") * level, F.col("cap")).alias("target"))


def step(lam: float, lo: float, hi: float, taken: float, slope: float, target: float) -> tuple[float, float, float]:
    """One Newton step, or a bisection where that leaves the bracket."""
    if taken < target:
        lo = lam
    else:
        hi = lam
    new = lam - (taken - target) / slope if slope > 0 else np.nan
    if not lo < new < hi:
        new = (lo + hi) / 2
    return new, lo, hi


def first_rates(histogram: DataFrame, most: float) -> DataFrame:
    """(key, lam, lo, hi) from at most a few thousand size bins a source."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        mean = pdf["source_size"].iloc[0] / max(pdf["n_docs"].iloc[0], 1)
        target, words, z = pdf["target"].iloc[0], pdf["words"].to_numpy(float), pdf["words"].to_numpy(float) / pdf["n"].to_numpy(float) / max(mean, 1e-9)
        lo, hi, lam = -700.0 / max(z.min(), 1e-3), np.log(most) / max(z.min(), 1e-9) if len(z) else 1.0, 0.0
        for _ in range(100):
            rate = np.exp(np.clip(lam * z, -700, np.log(most)))
            taken, slope = (words * rate).sum(), (words * rate * z)[lam * z < np.log(most)].sum()
            if abs(taken - target) <= 1e-12 * target:
                break
            lam, lo, hi = step(lam, lo, hi, taken, slope, target)
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "lam": [float(lam)]})

    return histogram.groupBy("key").applyInPandas(solve, "key string, lam double")


def rates(sizes: DataFrame, most: float = 3.0) -> DataFrame:
    """doc_id, size, key, source_size, target, rate."""
    targets = source_targets(sizes, most)
    keyed = sizes.select("doc_id", "size", source_key().alias("key"))
    bins = keyed.where("size > 0").groupBy("key", F.floor(F.log2("size") * 64).alias("bin")).agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    top = float(np.log(most))
    state = targets.join(first_rates(bins.join(targets.where("target < source_size * %r" % (most * (1 - 1e-12))), "key"), most), "key", "left")
    # between these all documents of a word or more go from no copy to most
    mean = F.greatest(F.col("source_size") / F.col("n_docs"), F.lit(1e-9))
    state = stored(state.withColumn("lo", -700.0 * mean).withColumn("hi", top * mean), "rates")
    z = F.col("size") / mean
    tilt = F.coalesce(F.col("lam") * z, F.lit(top))
    rate = F.exp(F.least(F.greatest(tilt, F.lit(-700.0)), F.lit(top)))
    by_size = stored(keyed.groupBy("key", "size").agg(F.count("*").alias("n")), "by_size")
    # sums of decimals do not depend on the order of the rows
    exact = lambda c: F.sum(c.cast("decimal(38,9)")).cast("double")
    for _ in range(MOST_PASSES):
        grouped = by_size.join(state.where("lam IS NOT NULL"), "key")
        sums = grouped.groupBy("key").agg(exact(F.col("n") * F.col("size") * rate).alias("taken"), exact(F.when(tilt < top, F.col("n") * F.col("size") * rate * z)).alias("slope"))
        after = stored(state.join(sums, "key", "left"), "rates")
        worst = after.agg(F.max(F.abs(F.col("taken") - F.col("target")) / F.greatest("target", F.lit(1.0)))).first()[0] or 0
        if worst < CLOSE:
            break
        less, new = F.col("taken") < F.col("target"), F.col("lam") - (F.col("taken") - F.col("target")) / F.nullif("slope", F.lit(0.0))
        after = after.withColumn("lo", F.when(less, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(less, F.col("hi")).otherwise(F.col("lam")))
        inside = F.when((new > F.col("lo")) & (new < F.col("hi")), new).otherwise((F.col("lo") + F.col("hi")) / 2)
        done = F.abs(F.col("taken") - F.col("target")) <= CLOSE * F.greatest("target", F.lit(1.0)) / 2
        state = stored(after.withColumn("lam", F.when(done | F.col("lam").isNull(), F.col("lam")).otherwise(inside)).drop("taken", "slope"), "rates")
    else:
        raise RuntimeError(f"a source missed its target by the share {worst} after {MOST_PASSES} passes")
    return keyed.join(state, "key").select("doc_id", "size", "key", "source_size", "n_docs", "target", rate.alias("rate"))


def diffuse(pdf: pd.DataFrame, most: float) -> pd.DataFrame:
    """Whole copies, longest document first; what is left over moves on."""
    pdf = pdf.sort_values(["size", "doc_id", "rate"], ascending=[False, True, True], na_position="last", kind="stable")
    left, copies = 0.0, []
    for size, rate in zip(pdf["size"].tolist(), pdf["rate"].tolist(), strict=True):
        if not size:
            copies.append(1)
            continue
        wanted = size * rate + left
        n = int(min(max(np.floor(wanted / size + 0.5), 0), most))
        copies.append(n)
        left = wanted - n * size
    pdf["copies"] = copies
    return pdf


def mixed(docs: DataFrame, most: float = 3.0) -> DataFrame:
    """doc_id, size, source_size, target, taken, rate, copies, key."""
    sizes = stored(sized(docs), "sizes")
    rated = rates(sizes, most)
    groups = F.greatest(F.ceil(F.col("n_docs") / GROUP), F.lit(1))
    salted = rated.withColumn("salt", F.pmod(F.xxhash64("doc_id", "size"), groups))
    fields = "doc_id long, size long, key string, source_size long, target double, rate double, copies int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return diffuse(pdf, most)[["doc_id", "size", "key", "source_size", "target", "rate", "copies"]]

    return salted.groupBy("key", "salt").applyInPandas(run, fields).withColumn("taken", F.col("size") * F.col("copies"))


def mix_report(docs: DataFrame, most: float = 3.0) -> DataFrame:
    return mixed(docs, most).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def resampled(docs: DataFrame, most: float = 3.0) -> DataFrame:
    """docs as the mix has them: each row as often as its copies say.

    Rows of one doc_id (or of none), source and size take the key's copies one
    by one: of its rows in order, as many take no more than c copies as the mix
    has."""
    key = ["__null", "__doc", "__key", "__size"]
    ident = F.col("doc_id").cast("long")
    keyed = lambda df: df.withColumn("__null", ident.isNull()).withColumn("__doc", F.coalesce(ident, F.lit(0)))
    steps = range(max(int(most), 1))
    plan = keyed(mixed(docs, most)).groupBy("__null", "__doc", F.col("key").alias("__key"), F.col("size").alias("__size")).agg(*(F.count(F.when(F.col("copies") <= c, 1)).alias(f"__to_{c}") for c in steps))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    own = keyed(docs).withColumn("__size", size).withColumn("__key", source_key())
    own = own.withColumn("__row", F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("text"))))
    copies = sum((F.when(F.col("__row") > F.col(f"__to_{c}"), 1).otherwise(0) for c in steps), F.lit(0))
    both = own.join(plan, key).withColumn("__copies", copies).where("__copies > 0")
    return both.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.sequence(F.lit(1), "__copies")).alias("__n")).drop("__n")
