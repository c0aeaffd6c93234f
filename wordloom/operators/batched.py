"""Definitions whose words meet in products, computed on rows as arrays: one matrix product a batch in place of joins of
single words. DuckDB keeps the relational spelling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators.solvers import second_moments
from wordloom.plans import relations

#: Vectors of the codebook: the first by number.
CODES = 16


def gram_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second moments of the columns; each batch sends its sums."""
    h = second_moments(spark, sf_dir)
    cells = [(i, j, float(h[i, j])) for i in range(len(h)) for j in range(len(h))]  # columns squared
    return spark.createDataFrame(cells, "i long, j long, h double").withColumn("h", F.round("h", 6))


def hadamard(size: int) -> np.ndarray:
    at = np.arange(size)
    return 1 - 2 * (np.bitwise_count(at[:, None] & at) % 2).astype(np.float64)


def hadamard_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows times the Hadamard matrix over its root; energy and peak of each tensor."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            if len(batch):
                x = np.stack(batch["xs"].to_numpy())
                y = x @ hadamard(x.shape[1]) / np.sqrt(x.shape[1])
                yield pd.DataFrame({"tensor": batch["tensor"], "energy": (y * y).sum(axis=1), "peak": np.abs(y).max(axis=1)}).groupby("tensor", as_index=False).agg({"energy": "sum", "peak": "max"})

    got = relations.values(spark, sf_dir).mapInPandas(run, "tensor long, energy double, peak double")
    return got.groupBy("tensor").agg(F.round(F.sum("energy"), 6).alias("energy"), F.round(F.max("peak"), 6).alias("peak"))


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, xs, code, distance: the nearest of CODES vectors, the first of equals."""
    rows = relations.values(spark, sf_dir)
    book = rows.filter(F.col("vec_id") < CODES).orderBy("vec_id").collect()  # CODES rows
    known = spark.sparkContext.broadcast((np.array([r.vec_id for r in book], np.int64), np.array([r.xs for r in book], np.float64)))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, vectors = known.value
        for batch in it:
            if len(batch) and len(codes):
                x = np.stack(batch["xs"].to_numpy())
                far = np.stack([np.round(((x - v) ** 2).sum(axis=1), 9) for v in vectors], axis=1)
                best = far.argmin(axis=1)
                yield pd.DataFrame({"vec_id": batch["vec_id"], "xs": batch["xs"], "code": codes[best], "distance": far[np.arange(len(x)), best]})

    return rows.mapInPandas(run, "vec_id long, xs array<double>, code long, distance double")


def nearest_codeword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir).select("vec_id", "code", F.round("distance", 6).alias("distance"))


def kmeans_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the members of each code; a batch sends a sum for each code that it holds."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            if len(batch):
                x, code = np.stack(batch["xs"].to_numpy()), batch["code"].to_numpy()
                for c in np.unique(code):
                    yield pd.DataFrame({"code": [c], "members": [int((code == c).sum())], "total": [x[code == c].sum(axis=0)]})

    sums = _assigned(spark, sf_dir).mapInPandas(run, "code long, members long, total array<double>")
    cells = sums.select("code", "members", F.posexplode("total").alias("c", "x")).groupBy("code", "c").agg(F.sum("members").alias("members"), F.sum("x").alias("x"))
    return cells.select("code", F.col("c").cast("long").alias("c"), F.round(F.col("x") / F.col("members"), 6).alias("centre"), "members")


QUERIES = {f.__name__: f for f in (gram_matrix, hadamard_rotation, nearest_codeword, kmeans_step)}
