"""The training-corpus pipeline: five stages, each written and read again.

Every stage takes and returns the columns of documents (the last one: digests)
and reads whole texts; columns beyond these are left out, so their names can't
clash.  An empty table gives an empty table.  Repeated rows, null texts and null
doc_ids have the results that each stage states.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import bpe, minhash, mixing, quality, substring
from graphloom.llm.common import drop_stored, stored, stored_in_batches

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, unchanged.  A null text is judged
    as an empty one; repeated rows, of equal score, stay or go together; rows
    without doc_id are judged, but not learnt from."""
    return quality.accepted(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each near-duplicate group
    (5-word shingles, similarity 0.8 or more).  Texts without words, null ones
    included, are in no group and stay.  Rows of one doc_id are one document: it
    goes if any of its texts is a near copy of an earlier document's, else the
    row of the least text stays.  Rows without doc_id stay."""
    docs = docs.select(COLUMNS)
    by_id = minhash.near_duplicates(docs, k=5, percent=80).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("kept").alias("__kept"), F.count("*").alias("__rows"))
    both = docs.join(by_id.where("__kept"), "doc_id")
    several = both.where("__rows > 1").withColumn("__row", F.row_number().over(Window.partitionBy("doc_id").orderBy("text", "source", "lang", "n_chars")))
    once = both.where("__rows = 1").select(COLUMNS).unionByName(several.where("__row = 1").select(COLUMNS))
    return once.unionByName(docs.where("doc_id IS NULL"))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 13-word windows that an earlier document has.  A text
    that loses nothing stays as it is, a null one too; one that loses all its
    words goes.  Rows without doc_id lose nothing and count for no other."""
    cut = substring.without_repeats(docs.select(COLUMNS), 13, as_text=True).where("__n_removed = 0 OR __n_removed < __n_words")
    n_chars = F.when(F.col("__n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars).select(COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.  Texts without words, null
    ones included, stay once; repeated rows are documents of their own."""
    return mixing.resampled(docs.select(COLUMNS))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and hashes of each document's ids and decoded text, one row a row;
    a null text counts as empty.  Texts go to Python in small batches: beside
    the stages before, those of 10,000 whole texts are too much for an executor."""
    return stored_in_batches(bpe.token_digests(docs.select(COLUMNS), public_tokenizers.path("word_bpe_49k.json")), 512, "digests")


STAGES = [
    ("quality classifier", quality_stage),
    ("near dedup", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]
#: The classifier and the tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        after = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            after = stored(after, "stage")
            drop_stored(docs)  # the stage before; documents themselves are not ours
        docs = after
    return docs
