"""The queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wordloom.llm.common import documents


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordloom.llm import pieces

    return pieces.query(spark, documents(spark, sf_dir), _vocabulary("piece_bpe_32k.model"))


def op2_sampled_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordloom.llm import sharding

    return sharding.query(spark, documents(spark, sf_dir))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordloom.llm import token_files

    return token_files.query(spark, documents(spark, sf_dir), _vocabulary("byte_bpe_50k.json"))


def op4_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordloom.llm import quality

    return quality.query(spark, documents(spark, sf_dir))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordloom.llm import packing

    return packing.query(spark, documents(spark, sf_dir), _vocabulary("byte_bpe_50k.json"))


def op6_hashed_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordloom.llm import maxent

    return maxent.query(spark, documents(spark, sf_dir))


def op7_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordloom.llm import secrets

    return secrets.query(spark, documents(spark, sf_dir))


def op8_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordloom.llm import simhash

    return simhash.query(spark, documents(spark, sf_dir))


def op9_bloom_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordloom.llm import bloom_dedup

    return bloom_dedup.query(spark, documents(spark, sf_dir))


def op10_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordloom.llm import pii

    return pii.query(spark, documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in sorted(globals().items()) if name.startswith("op") and callable(f)}
