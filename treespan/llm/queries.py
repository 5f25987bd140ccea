"""The queries of this subpackage and their SQL, for the driver contract."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, bpe, collision, linededup, mixing, multiindex, quality, tokenstore, toxicity, urlrules


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_bytes(name: str) -> bytes:
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = bpe.encode(docs, file_bytes("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages"), urlrules.rule_table(spark, urlrules.RULES))


def crc(name: str = "doc_id"):
    return F.crc32(F.col(name).cast("string").cast("binary"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = quality.score(docs, quality.learn(docs, labels))
    return out.select("doc_id", (crc() % 5 == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = toxicity.score(docs, toxicity.learn(docs, labels))
    return out.select("doc_id", (crc() % 3 == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "evidence")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.classes(table(spark, sf_dir, "documents"))


def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.per_document(table(spark, sf_dir, "documents"), linededup.QUERY_TAU, chars=linededup.QUERY_CHARS)


def op8_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision.search(table(spark, sf_dir, "embeddings"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.round_trip(table(spark, sf_dir, "documents"), file_bytes("word_bpe_49k.json"), end=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_mixing": op3_mixing,
    "op4_multi_index": op4_multi_index,
    "op5_url_rules": op5_url_rules,
    "op6_quality": op6_quality,
    "op7_line_dedup": op7_line_dedup,
    "op8_collision_counting": op8_collision_counting,
    "op9_toxicity": op9_toxicity,
    "op10_token_store": op10_token_store,
}
SQL: dict[str, str] = {"op3_mixing": mixing.SQL, "op5_url_rules": urlrules.SQL}
