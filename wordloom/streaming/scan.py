"""Exponent histograms of tensors whose rows arrive over time, for triage before a tensor is complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from wordloom.plans.relations import words_of

SCHEMA = "vec_id long, embedding array<float>, label int"


def exponent_counts(rows: DataFrame) -> DataFrame:
    """rows (label, embedding), streaming or not, to tensor, e, n. State is at most 256 counts a tensor."""
    cells = rows.select(F.col("label").cast("long").alias("tensor"), F.explode(words_of("embedding")).alias("w"))
    return cells.groupBy("tensor", F.shiftright("w", 7).bitwiseAND(F.lit(255)).alias("e")).agg(F.count("*").alias("n"))


def entropy(counts: DataFrame) -> DataFrame:
    """tensor, n_words, bits: exponent entropy of what has arrived."""
    share = F.col("n") / F.col("n_words")
    return counts.withColumn("n_words", F.sum("n").over(Window.partitionBy("tensor"))).groupBy("tensor").agg(F.max("n_words").alias("n_words"), F.round(F.sum(-share * F.log2(share)), 6).alias("bits"))


def watch(spark: SparkSession, folder: str, table: str, checkpoint: str) -> StreamingQuery:
    """Keep exponent counts of all files that arrive in folder in the in-memory table; a restart goes on from the
    checkpoint's list of files."""
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 64).parquet(folder)
    return exponent_counts(rows).writeStream.outputMode("complete").format("memory").queryName(table).option("checkpointLocation", checkpoint).start()
