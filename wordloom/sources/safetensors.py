"""A Spark data source for safetensors files of 16-bit words, and a writer.

    register(spark)
    spark.read.format("safetensors").load("/path/of/files")

A file begins with a little-endian uint64, the length of a JSON header {name: {dtype, shape, data_offsets}}, and the
data. Planning reads headers alone; a partition is a range of words of one tensor, read by its bytes. A filter on
`tensor` drops the other tensors' partitions, and bounds on the row `r` leave only the bytes of those rows to be read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Types of 16 bits; others are listed by the inventory and not read.
WORD_TYPES = ("BF16", "F16", "FP16")
RANGE_WORDS = 1 << 20


@dataclass
class Range(InputPartition):
    path: str
    tensor: str
    dtype: str
    cols: int
    at: int
    first: int
    count: int


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def files(path: str) -> list[str]:
    from pyarrow import fs

    system, root = _system(path)
    info = system.get_file_info(root)
    if info.is_file:
        return [path]
    prefix = path.split("://")[0] + "://" if "://" in path else ""
    return sorted(prefix + f.path for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.path.endswith(".safetensors"))


def read_header(path: str) -> tuple[dict, int]:
    """The header, and where data begin."""
    system, at = _system(path)
    with system.open_input_file(at) as f:
        size = int.from_bytes(f.read(8), "little")
        header = json.loads(f.read(size))
    header.pop("__metadata__", None)
    return header, 8 + size


def logical_shape(shape: list[int]) -> tuple[int, int]:
    """Rows and columns: a vector is one row, further dimensions join the columns."""
    if not shape:
        return 0, 0
    return (1, shape[0]) if len(shape) == 1 else (shape[0], int(np.prod(shape[1:])))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """One row a tensor, all types: tensor, dtype, shape, n_words, n_bytes, path. Headers are read by tasks."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for file in b.column(0).to_pylist():
                rows = [(name, e["dtype"], e["shape"], int(np.prod(e["shape"], dtype=np.int64)), e["data_offsets"][1] - e["data_offsets"][0], file) for name, e in read_header(file)[0].items()]
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                types = [pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()]
                yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["tensor", "dtype", "shape", "n_words", "n_bytes", "path"])

    known = files(path)
    dealt = spark.createDataFrame([(f,) for f in known], "path string").repartition(max(1, min(len(known), 1024)))
    return dealt.mapInArrow(run, "tensor string, dtype string, shape array<long>, n_words long, n_bytes long, path string").orderBy("tensor")


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.names, self.low, self.high = path, None, 0, None

    def pushFilters(self, filters):
        """Filters are joined by AND, so each narrows what those before it left."""
        for f in filters:
            own = getattr(f, "attribute", None)
            if own == ("tensor",) and isinstance(f, (EqualTo, In)):
                found = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = found if self.names is None else self.names & found
            elif own == ("r",):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    top = f.value - isinstance(f, LessThan)
                    self.high = top if self.high is None else min(self.high, top)
            yield f  # Spark checks again

    def partitions(self) -> list[Range]:
        out = []
        for file in files(self.path):
            header, base = read_header(file)
            for name, entry in sorted(header.items()):
                if entry["dtype"] not in WORD_TYPES or self.names is not None and name not in self.names:
                    continue
                rows, cols = logical_shape(entry["shape"])
                start, end = entry["data_offsets"]
                if end - start != 2 * rows * cols:
                    raise ValueError(f"{name}: {end - start} bytes do not hold {rows} x {cols} words")
                first, last = self.low * cols, (rows if self.high is None else max(0, min(rows, self.high + 1))) * cols
                out += [Range(file, name, entry["dtype"], cols, base + start + 2 * i, i, min(RANGE_WORDS, last - i)) for i in range(first, last, RANGE_WORDS)]
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a plan without partitions
            return
        system, at = _system(partition.path)
        with system.open_input_file(at) as f:
            f.seek(partition.at)
            words = np.frombuffer(f.read(2 * partition.count), "<u2")
        place = np.arange(partition.first, partition.first + len(words))
        n = len(words)
        yield pa.record_batch([pa.array([partition.tensor] * n), pa.array([partition.dtype] * n), pa.array(place // partition.cols), pa.array(place % partition.cols), pa.array(words.astype(np.int32))], ["tensor", "dtype", "r", "c", "w"])


class SafetensorsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "safetensors"

    def schema(self) -> str:
        return "tensor string, dtype string, r long, c long, w int"

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known, and let filters on `tensor` reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SafetensorsSource)


def write(words: DataFrame, path: str) -> DataFrame:
    """words (tensor, dtype, r, c, w) to one file a tensor below path; returns tensor, path, n_words. A file is written
    under another name and then moved, so that a lost task leaves nothing that counts."""
    shapes = words.groupBy("tensor").agg(F.max("dtype").alias("dtype"), (F.max("r") + 1).alias("n_rows"), (F.max("c") + 1).alias("n_cols"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _system(path)
        system.create_dir(root, recursive=True)
        now, out, seen = None, None, 0

        def close() -> pa.RecordBatch:
            out.close()
            final = f"{root}/{now.replace('/', '_')}.safetensors"
            system.move(final + ".part", final)
            return pa.record_batch([pa.array([now]), pa.array([final]), pa.array([seen], pa.int64())], ["tensor", "path", "n_words"])

        for b in it:
            for name, dtype, rows, cols, w in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if name != now:
                    if now is not None:
                        yield close()
                    now, seen = name, 0
                    header = json.dumps({name: {"dtype": dtype, "shape": [rows, cols], "data_offsets": [0, 2 * rows * cols]}}).encode()
                    header += b" " * (-len(header) % 8)
                    out = system.open_output_stream(f"{root}/{name.replace('/', '_')}.safetensors.part")
                    out.write(len(header).to_bytes(8, "little") + header)
                out.write(np.asarray(w, "<u2").tobytes())
                seen += len(w)
        if now is not None:
            yield close()

    by_row = words.groupBy("tensor", "r").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "w"))), lambda x: x.w).alias("ws"))
    ready = by_row.join(shapes, "tensor").repartition("tensor").sortWithinPartitions("tensor", "r").select("tensor", "dtype", "n_rows", "n_cols", "ws")
    return ready.mapInArrow(run, "tensor string, path string, n_words long")
