"""Where words of tensors come from, behind one interface, and forms of tiles as plug-ins.

`WeightSource` is what a forward pass or a scan needs: a tensor, a range of its rows, a hint of what comes next. Words may
be held (a cached frame), read from files by byte ranges, or decoded from containers as they are read; a decoded copy can
be put beside the containers and is used while it is as fresh as they are.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators import archive
from wordloom.sources import containers


class TileForm(Protocol):
    """A form of tiles: bytes without making them, making them, and reading them."""

    mode: int
    name: str

    def estimate(self, words: np.ndarray) -> int: ...

    def encode(self, words: np.ndarray) -> bytes: ...

    def decode(self, payload: bytes, rows: int, cols: int) -> np.ndarray: ...


#: Forms that were added, by number.
FORMS: dict[int, TileForm] = {}


def register(form: TileForm) -> None:
    if form.mode in FORMS or form.mode in archive.MODES.values():
        raise ValueError(f"there is a form {form.mode} already")
    FORMS[form.mode] = form


def cheapest(words: np.ndarray) -> tuple[int, str, bytes]:
    """The cheapest of the archive's own forms and those added, ties by number."""
    name, payload = archive.encode_tile(words)
    best = (len(payload), archive.MODES[name], name, payload)
    for mode, form in sorted(FORMS.items()):
        if form.estimate(words) <= best[0]:
            made = form.encode(words)
            best = min(best, (len(made), mode, form.name, made))
    return best[1:]


def read(mode: int, name: str, payload: bytes, rows: int, cols: int) -> np.ndarray:
    return FORMS[mode].decode(payload, rows, cols) if mode in FORMS else archive.decode_tile(name, payload, rows, cols)


class WeightSource(Protocol):
    def load(self, tensor: int) -> DataFrame: ...

    def rows(self, tensor: int, first: int, count: int) -> DataFrame: ...

    def prefetch(self, *tensors: int) -> None: ...


class Frame:
    """Rows (tensor, r, ws) of any frame. `prefetch` holds tensors in memory and on disk until `release`."""

    def __init__(self, rows: DataFrame):
        self.all, self.held = rows, {}

    def load(self, tensor: int) -> DataFrame:
        return self.held.get(tensor, self.all.filter(F.col("tensor") == tensor))

    def rows(self, tensor: int, first: int, count: int) -> DataFrame:
        return self.load(tensor).filter((F.col("r") >= first) & (F.col("r") < first + count))

    def prefetch(self, *tensors: int) -> None:
        for t in tensors:
            if t not in self.held:
                self.held[t] = self.load(t).persist(StorageLevel.MEMORY_AND_DISK)

    def release(self, *tensors: int) -> None:
        for t in tensors:
            if t in self.held:
                self.held.pop(t).unpersist()


def sidecar(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the containers at path, from the decoded copy beside them; that is made where there is none, or where it is
    not of these containers."""
    index = containers.index(spark, path)
    beside = f"{path.rstrip('/')}-decoded"
    system = spark._jvm.org.apache.hadoop.fs.Path(beside)
    if system.getFileSystem(spark._jsc.hadoopConfiguration()).exists(system):
        known = spark.read.parquet(f"{beside}/index")
        if known.exceptAll(index).isEmpty() and index.exceptAll(known).isEmpty():
            return spark.read.parquet(f"{beside}/rows")
    containers.read_tensors(spark, path).repartition("tensor").sortWithinPartitions("tensor", "r").write.mode("overwrite").parquet(f"{beside}/rows")
    index.write.mode("overwrite").parquet(f"{beside}/index")
    return spark.read.parquet(f"{beside}/rows")


def guarded(spark: SparkSession, path: str, sha256: dict[int, str]) -> DataFrame:
    """Rows of the containers at path, if they are the ones that are expected."""
    found = {r.tensor: r.sha256 for r in containers.index(spark, path).collect()}
    if wrong := [t for t, s in sha256.items() if found.get(t) != s]:
        raise ValueError(f"containers of tensors {wrong} are others than expected")
    return containers.read_tensors(spark, path)
