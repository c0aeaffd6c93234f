"""What a user runs on a folder of safetensors files: scan and rank, compare menus, look for what blocks, pack, unpack and
verify, and compare two versions. Each returns DataFrames or short reports.

A tensor of any shape is taken as its words in raster order, in rows of the largest divisor of their number up to ROW, so
every definition over words applies to it. Tensors have numbers by name; `named` puts the names back.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators import archive, menu, reports
from wordloom.plans import dialect, relations
from wordloom.sources import containers, safetensors

ROW = 64


def tensors(spark: SparkSession, path: str) -> DataFrame:
    """number, tensor, dtype, shape, n_words, width of the 16-bit tensors below path: some thousands of rows."""
    rows = [r for r in safetensors.inventory(spark, path).collect() if r.dtype in safetensors.WORD_TYPES]
    return spark.createDataFrame([(i, r.tensor, r.dtype, list(r.shape), r.n_words, max(w for w in range(1, ROW + 1) if r.n_words % w == 0)) for i, r in enumerate(rows)], "number long, tensor string, dtype string, shape array<long>, n_words long, width long")


def _floats(words: pd.Series) -> pd.Series:
    return pd.Series([(np.asarray(w, np.uint32) << 16).view(np.float32).astype(np.float64) for w in words])


def rows(spark: SparkSession, path: str) -> DataFrame:
    """tensor (number), vec_id, r, xs, ws: rows of `width` words."""
    safetensors.register(spark)
    known = tensors(spark, path)
    cols = F.when(F.size("shape") <= 1, F.col("n_words")).otherwise(F.col("n_words") / F.greatest(F.get("shape", F.lit(0)), F.lit(1))).cast("long")
    words = spark.read.format("safetensors").load(path).join(F.broadcast(known.select("tensor", "number", "width", cols.alias("cols"))), "tensor")
    flat = words.select(F.col("number").alias("tensor"), "width", (F.col("r") * F.col("cols") + F.col("c")).alias("place"), F.col("w").cast("long").alias("w"))
    made = flat.groupBy("tensor", F.expr("place div width").alias("r")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "w"))), lambda x: x.w).alias("ws"))  # ROW words
    return made.select("tensor", (F.col("tensor") * (1 << 40) + F.col("r")).alias("vec_id"), "r", F.pandas_udf(_floats, "array<double>")("ws").alias("xs"), "ws")


def named(result: DataFrame, known: DataFrame) -> DataFrame:
    return result.withColumnRenamed("tensor", "number").join(F.broadcast(known.select("number", "tensor")), "number", "left").drop("number")


def run(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    """Definitions over the words below path, by name."""
    known, words = tensors(spark, path), relations.spread(rows(spark, path))
    made = {n: dialect.run_on(n, words) for n in names}
    return {n: named(df, known) if "tensor" in df.columns else df for n, df in made.items()}


def qualify(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Scan: fields and residuals, coverage, the cheapest encodings, the leaderboard and the summary."""
    return run(spark, path, "field_entropy", "residual_entropy", "coverage_top4", "mode_usage", "qualify_leaderboard", "qualification_summary")


def blockers(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """What keeps tensors from being smaller: entropies and their gaps, repetition, duplicates across tensors."""
    return run(spark, path, "field_gap", "residual_entropy", "tile_repetition", "cross_tensor_duplicates", "default_residual_stats")


def ablation(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Bytes under each named menu, one table against tiles, and the best block size."""
    return run(spark, path, "profile_sizes", "whole_or_tiles", "block_size_choice")


def mantissas(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """What is to be had in mantissas: given the exponent, by bit contexts, by rules, in adaptive blocks."""
    return run(spark, path, "holdout_nll_exponent", "bit_markov_nll", "depth_mixture_nll", "six_context_rules", "adaptive_blocks")


def pack(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Compress all tensors below path into out, check that they come back, and return the index with names."""
    own = rows(spark, path).select("tensor", "r", "ws")
    containers.write_tensors(archive.compress(own), out)
    tensors(spark, path).write.mode("errorifexists").parquet(f"{out.rstrip('/')}-names")
    return verify(spark, path, out)


def verify(spark: SparkSession, path: str, out: str) -> DataFrame:
    """tensor, n_words, size, differing; raises if any word differs."""
    checked = archive.verified(rows(spark, path).select("tensor", "r", "ws"), containers.read_tensors(spark, out))
    got = checked.join(containers.index(spark, out).select("tensor", "size"), "tensor")
    wrong = got.filter("differing > 0").count()
    if wrong:
        raise ValueError(f"{wrong} tensors do not come back")
    return named(got, tensors(spark, path))


def unpack(spark: SparkSession, out: str, path: str) -> DataFrame:
    """Write the tensors of out below path as safetensors files, with their names, types and shapes."""
    known = spark.read.parquet(f"{out.rstrip('/')}-names")
    back = containers.read_tensors(spark, out).withColumnRenamed("tensor", "number").join(F.broadcast(known), "number")
    cols = F.when(F.size("shape") <= 1, F.col("n_words")).otherwise(F.col("n_words") / F.greatest(F.get("shape", F.lit(0)), F.lit(1))).cast("long")
    cells = back.select("tensor", "dtype", "width", cols.alias("cols"), "r", F.posexplode("ws").alias("c", "w"))
    place = F.col("r") * F.col("width") + F.col("c")
    words = cells.select("tensor", "dtype", F.floor(place / F.col("cols")).cast("long").alias("r"), (place % F.col("cols")).alias("c"), F.col("w").cast("int").alias("w"))
    return safetensors.write(words, path)


def compare(spark: SparkSession, base: str, target: str) -> DataFrame:
    """Of two folders: tensors of one name and shape with their words, changed words, mean differing bits and bytes of a
    patch; and those that only one has."""
    a, b = (tensors(spark, p).select("tensor", "shape", "number", "n_words") for p in (base, target))
    joined = a.join(b, ["tensor", "shape"], "full").select("tensor", a.number.alias("na"), b.number.alias("nb"), F.coalesce(a.n_words, b.n_words).alias("n_words"))
    x, y = (rows(spark, p).select(F.col("tensor").alias(n), "r", F.col("ws").alias(w)) for p, n, w in ((base, "na", "wa"), (target, "nb", "wb")))
    both = x.join(F.broadcast(joined.filter("na IS NOT NULL AND nb IS NOT NULL")), "na").join(y, ["nb", "r"])
    xor = F.zip_with("wa", "wb", lambda p, q: p.bitwiseXOR(q))
    per = both.select("tensor", F.size(F.filter(xor, lambda z: z != 0)).alias("changed"), F.aggregate(xor, F.lit(0).cast("long"), lambda s, z: s + F.bit_count(z)).alias("bits"))
    sums = per.groupBy("tensor").agg(F.sum("changed").alias("changed"), F.sum("bits").alias("bits"))
    side = F.when(F.col("nb").isNull(), "base").when(F.col("na").isNull(), "target").otherwise("both")
    patch = F.least(4 + 4 * F.col("changed"), F.expr("(n_words + 7) div 8")) + 2 * F.col("changed")
    return joined.select("tensor", side.alias("side"), "n_words").join(sums, "tensor", "left").select("tensor", "side", "n_words", F.when(F.col("side") == "both", F.col("changed")).alias("changed"), F.when(F.col("side") == "both", F.col("bits") / F.col("n_words")).alias("mean_bits"), F.when(F.col("side") == "both", patch).alias("patch_bytes"))


def report(results: dict[str, DataFrame], form: str = "markdown") -> str:
    write = {"markdown": lambda n, r: reports.as_markdown(r, n), "csv": lambda n, r: reports.as_csv(r), "json": lambda n, r: reports.as_json(r, name=n)}[form]
    return "\n".join(write(n, reports.rows_of(df)) for n, df in results.items())


#: Drivers whose result is a report of several tables.
REPORTS = {f.__name__: f for f in (qualify, blockers, ablation, mantissas)}
MENUS = menu.PROFILES
