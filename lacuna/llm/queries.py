"""The operators of this package as registered queries on the test tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import (codes, jaccard, katz, mixing, packing, phrases, quality, ranked, sharding, substrings, topk,
                        toxicity, url_filter)
from lacuna.llm.sql import ORACLE  # noqa: F401

RULES = (("block", "net/"), ("allow", "example.net/en/"),
         ("block", "example.com/de/"), ("allow", "org/fr/"))


VOCABULARY = packing.Vocabulary(
    public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
    public_tokenizers.PATTERN)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), VOCABULARY)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), RULES)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jaccard.near_duplicates(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_shingles", "component_id")


def op4_phrase_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.fingerprint_edits(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(_table(spark, sf_dir, "documents"), weights=(1, 2, 3), cap=3.0)
    return rows.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = sharding.topology(40)
    rows = sharding.shard_documents(_table(spark, sf_dir, "documents"), tree, sharding.grow(tree))
    return rows.withColumn("law", F.lit("key"))


def toxicity_categories() -> dict[str, Column]:
    """The labels' two columns as a chain; quality comes first and toxicity last."""
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"),
                          toxicity_categories())


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"))


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return katz.score_documents(_table(spark, sf_dir, "documents"), held_out)


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


def op11_anchor_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(_table(spark, sf_dir, "embeddings"))


def op12_sketch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


def op13_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_documents(_table(spark, sf_dir, "documents")).drop("host_verdict", "host", "n_lines")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_url_filter": op2_url_filter,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_phrase_fingerprint": op4_phrase_fingerprint,
    "op5_mixing": op5_mixing,
    "op6_sharding": op6_sharding,
    "op7_toxicity": op7_toxicity,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_katz": op9_katz,
    "op10_top_k": op10_top_k,
    "op11_anchor_codes": op11_anchor_codes,
    "op12_sketch_search": op12_sketch_search,
    "op13_host_rules": op13_host_rules,
}
