"""Controlled tensors with a known pattern, made where they are needed: one row a word, by expressions on its place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the patterns.
PALETTE = [0x3C00, 0xBC00, 0x3E00, 0x0000]
CONSTANT = 0x3E00
EXPONENTS = [120, 121, 127, 128]
SPECIALS = [0x0000, 0x8000, 0x7F80, 0xFF80, 0x7FC1, 0x7F81, 0x0001, 0x8001]
CASES = ["repeated_values", "constant_block", "duplicate_blocks", "near_duplicate_blocks", "repeated_residuals", "previous_value_runs", "previous_row", "component_concentration", "special_payloads", "random"]


def _random(bound: int, seed: int, *columns: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(bound))


def _pick(values: list[int], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1).cast("long")


def generate(spark: SparkSession, case: str, words: int = 4096, cols: int = 64, block: int = 256, seed: int = 7) -> DataFrame:
    """r, c, w."""
    i = F.col("id")
    within, row, col = i % block, F.floor(i / cols).cast("long"), i % cols
    flips = _random(65536, seed, within).bitwiseXOR(F.when(_random(64, seed + 1, i) == 0, _pick([1 << k for k in range(16)], _random(16, seed + 2, i))).otherwise(F.lit(0).cast("long")))
    field = lambda s, e, m: F.shiftleft(s, 15).bitwiseOR(F.shiftleft(e, 7)).bitwiseOR(m)
    word = {
        "repeated_values": lambda: _pick(PALETTE, _random(4, seed, i)),
        "constant_block": lambda: F.lit(CONSTANT).cast("long"),
        "duplicate_blocks": lambda: _random(65536, seed, within),
        "near_duplicate_blocks": lambda: flips,
        "repeated_residuals": lambda: F.lit(CONSTANT).cast("long").bitwiseXOR(i % 3),
        "previous_value_runs": lambda: _random(65536, seed, F.floor(i / 32)),
        "previous_row": lambda: _random(65536, seed, col),
        "component_concentration": lambda: field(_random(2, seed, i), _pick(EXPONENTS, _random(4, seed + 1, i)), _random(128, seed + 2, i)),
        "special_payloads": lambda: F.when(i < len(SPECIALS), _pick(SPECIALS, F.least(i, F.lit(len(SPECIALS) - 1)))).otherwise(_random(65536, seed, i)),
        "random": lambda: _random(65536, seed, i),
    }[case]()
    return spark.range(words).select(row.alias("r"), col.alias("c"), word.alias("w"))


def manifest(spark: SparkSession, words: int = 4096, cols: int = 64, block: int = 256, seed: int = 7) -> DataFrame:
    """case, seed, words, rows, cols, byte_count, distinct_words, word_sum: one row a case."""
    out = None
    for case in CASES:
        one = generate(spark, case, words, cols, block, seed).agg(F.count("*").alias("words"), F.countDistinct("w").alias("distinct_words"), F.sum("w").alias("word_sum"))
        one = one.select(F.lit(case).alias("case"), F.lit(seed).alias("seed"), "words", F.lit(-(-words // cols)).alias("n_rows"), F.lit(cols).alias("n_cols"), (2 * F.col("words")).alias("byte_count"), "distinct_words", "word_sum")
        out = one if out is None else out.unionByName(one)
    return out
