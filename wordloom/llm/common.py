"""Shared plumbing of the training-data operators: shared-folder tables, bounded merges, null handling."""

from __future__ import annotations

import contextlib
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in an Arrow batch sent to Python, whichever are reached first; documents may be long. Also the bytes of
#: text that Python works on at a time, however many there are in a batch.
BATCH_ROWS, BATCH_BYTES = 4000, 16 << 20
#: Rows of one key that a merge step reads into one task.
FAN_IN = 64
#: Rows of one key that a join gives to one task, and keys that can have more (the bound of what is broadcast).
HEAVY, MOST_HEAVY = 1000, 1 << 14
#: Rows of fixed width, or elements of arrays of such, that may be broadcast (some 20 MB).
FEW = 1 << 18


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def prepare(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long documents."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset on one machine (tests), a folder made here."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    made = getattr(shared_dir, "made", None)
    if made is None:
        made = shared_dir.made = "file://" + tempfile.mkdtemp(prefix="wordloom-")
        spark.sparkContext.setCheckpointDir(made)
    return made


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/wordloom-{spark.sparkContext.applicationId}"


_scratch: dict[str, list[str]] = {"open": [], "closed": []}


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that `stored` writes inside are removed when the next scratch opens: what was made of them has to be
    written by then. Shuffle files that nothing refers to any more go with them."""
    for path in _scratch["closed"]:
        own = spark._jvm.org.apache.hadoop.fs.Path(path)
        own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)
    gc.collect()
    spark._jvm.System.gc()
    _scratch["closed"], _scratch["open"] = [], []
    try:
        yield
    finally:
        _scratch["closed"], _scratch["open"] = _scratch["open"], []


def few(table: DataFrame) -> bool:
    """Whether a stored table of fixed width may be broadcast."""
    return table.count() <= FEW


def stored(df: DataFrame, name: str, codec: str = "zstd", by: str | None = None) -> DataFrame:
    """Write df below the shared folder and read it back: cuts the lineage and survives lost executors. by: a column of
    whose values each has a folder, so that a filter on one reads nothing else."""
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch["open"].append(path)
    df.write.option("compression", codec).partitionBy(*([by] if by else [])).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_text(column: str = "text") -> Column:
    """Null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def salted_join(rows: DataFrame, table: DataFrame, key: str, count: str, narrow: bool = True) -> DataFrame:
    """rows joined with table (stored, one row a key, `count` of rows that have it; narrow: of columns of fixed width).
    A narrow table of FEW rows at most is broadcast. Otherwise the rows of a key with over HEAVY of
    them are dealt over several tasks, each with a copy of the key's row: as many copies as the rows over HEAVY, so
    the copies are fewer than the rows over HEAVY, too. Which keys those are is read from the table's counts; both
    sides carry the number of shares, the rows by a broadcast of heavy keys, of which there are MOST_HEAVY at most."""
    total, most, size = table.agg(F.sum(count), F.max(count), F.count("*")).first()
    if narrow and size <= FEW:
        return rows.join(F.broadcast(table), key)
    share = max(HEAVY, (total or 0) // MOST_HEAVY)
    if (most or 0) <= share:
        return rows.join(table.hint("merge"), key)
    heavy = F.broadcast(table.filter(F.col(count) > share).select(key, F.ceil(F.col(count) / share).cast("int").alias("wl_shares")))
    shares = F.ceil(F.greatest(F.col(count), F.lit(1)) / share).cast("int")
    spread = table.withColumn("wl_salt", F.explode(F.sequence(F.lit(0), shares - 1)))
    others = [c for c in rows.columns if c != key]
    salted = rows.join(heavy, key, "left").withColumn("wl_salt", F.pmod(F.xxhash64(*others), F.coalesce("wl_shares", F.lit(1))).cast("int")).drop("wl_shares")
    return salted.join(spread.hint("merge"), [key, "wl_salt"]).drop("wl_salt")


def places(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each value of a string or binary array begins in its buffer, and its bytes."""
    kind = np.int64 if pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type) else np.int32
    ends = np.frombuffer(values.buffers()[1], kind, len(values) + 1, values.offset * kind().itemsize) if len(values) else np.zeros(1, kind)
    return ends[:-1].astype(np.int64), np.diff(ends).astype(np.int64)


def split_words(rows: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The words of lower-case texts ([^\\x20\\x09-\\x0D]+, A-Z lowered): the distinct ones, which of them each word of all
    texts is, one after another, and where each text begins and the last ends."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(rows.cast(pa.large_string())))
    ends = parts.offsets.to_numpy().astype(np.int64)
    ends -= ends[0]
    words = parts.flatten().dictionary_encode()
    distinct = [w.encode() for w in words.dictionary.to_numpy(zero_copy_only=False).tolist()]
    index = words.indices.to_numpy().astype(np.int64)
    if b"" in distinct:  # white space at either end leaves an empty word
        empty = distinct.index(b"")
        filled = index != empty
        ends, index = np.concatenate([[0], np.cumsum(filled)])[ends], index[filled]
    return distinct, index, ends


def stretches(values: pa.Array, most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Cut a string or binary array so that no stretch of several values has over `most` bytes."""
    at, size = places(values)
    first = 0
    while first < len(values):
        last = max(first + 1, int(np.searchsorted(at + size, at[first] + most, "right")))
        yield first, last
        first = last


def merged(df: DataFrame, key: str, part: str, value_names: list[str], merge: Callable[[list[tuple]], tuple], parts: int) -> DataFrame:
    """Merge the rows of each key, at most FAN_IN rows to a task at a time, in a tree.

    df has key, part (the number of the partition that made the row, below `parts`) and the binary columns
    value_names. merge takes the value tuples of up to FAN_IN rows and returns one tuple.
    """
    schema = f"{key} long, {part} long, " + ", ".join(f"{n} binary" for n in value_names)

    def step(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        got = merge(list(zip(*(rows[n] for n in value_names), strict=True)))
        return pa.table({key: pa.array([rows[key][0]], pa.int64()), part: pa.array([rows[part][0] // FAN_IN], pa.int64())} | {n: pa.array([v], pa.binary()) for n, v in zip(value_names, got, strict=True)})

    df = df.select(key, part, *value_names)
    while parts > FAN_IN:
        df = df.groupBy(key, F.floor(F.col(part) / FAN_IN).cast("long").alias("wl_group")).applyInArrow(lambda t: step(t), schema)
        parts = -(-parts // FAN_IN)
    return df.groupBy(key).applyInArrow(step, schema).select(key, *value_names)
