"""The queries of the training-data operators, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import bpe, embed_graph, knn, langid, license, minhash, mixing, quality, slots, substring
from graphloom.llm.common import documents


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_graph.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.98, audit=0.9)


def op2_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.without_repeats(documents(spark, sf_dir), length=13)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf_dir), most=3.0)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), k=4, percent=80)


def op7_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan_documents(documents(spark, sf_dir), threshold=0.8)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(documents(spark, sf_dir), tokenizer_path())


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"), bar=0.3)


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return slots.training_order(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_graph": op1_embedding_graph,
    "op2_voronoi_knn": op2_voronoi_knn,
    "op3_substring": op3_substring,
    "op4_langid": op4_langid,
    "op5_mixing": op5_mixing,
    "op6_minhash": op6_minhash,
    "op7_license": op7_license,
    "op8_bpe": op8_bpe,
    "op9_quality": op9_quality,
    "op10_training_order": op10_training_order,
}

INTS = "(SELECT vec_id, [CAST(floor(64 * x) AS BIGINT) for x in CAST(embedding AS DOUBLE[])] AS v FROM embeddings WHERE embedding IS NOT NULL)"
ORACLES: dict[str, str] = {
    # dot products of whole numbers, exact in double precision
    "op2_voronoi_knn": f"SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])) AS BIGINT) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(CAST(q.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])) DESC, d.vec_id) AS rank FROM {INTS} q JOIN {INTS} d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id) WHERE rank <= 20",
}
