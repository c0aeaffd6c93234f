"""Exact dedup in two passes with a Bloom filter.

Pass 1 tells for each cell of a filter whether it is hit more than once (cells meet by piece of the filter). Pass 2: a row whose cells were all hit twice or more may be repeated; only such rows
shuffle, to be grouped by their whole SHA-256. All other rows are unique for certain and pass straight through.
False alarms of the filter cost a shuffle and nothing else, so its size (a proven bound on what is broadcast) never
changes a result; where more rows come than the largest filter serves, digests are dealt into slices with a filter each.

Texts are equal when they are identical without the characters of [\\x20\\x09-\\x0D]. Of equal texts the row with the
most code points in its original text stays, then the smallest id.

Cases: null text counts as empty, and empty texts equal one another; a null id sorts before all others; rows that
repeat an id are rows of their own, and where the best (code points, id) itself repeats, `kept` is true for each such
row in `decisions`, while `kept_rows` returns one of them; an empty table gives no rows.
Other columns are not read by `decisions` and pass through `kept_rows`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import prepare, salted_join, stored, whole_text

SPACE = b" \t\n\x0b\x0c\r"
#: Cells for each row, hashes of a row, and the most cells: at one bit each, 256 MB is the largest broadcast.
CELLS, HASHES, MOST_CELLS = 16, 4, 1 << 31
#: Cells of one mergeable piece of the filter.
PIECE = 1 << 15


def normalised(text: str) -> bytes:
    return text.encode().translate(None, SPACE)


def _digests(texts: list[str]) -> list[bytes]:
    return [hashlib.sha256(normalised(t)).digest() for t in texts]


def _cells(digests: list[bytes], cells: int) -> np.ndarray:
    """HASHES cells for each digest. cells is a power of two."""
    words = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 4)[:, :HASHES]
    return (words & np.uint64(cells - 1)).astype(np.int64)


def _hashed(rows: DataFrame, text: str) -> DataFrame:
    """rows with n_chars (code points of the original text), digest, and wl_pos (a number of each row); stored."""
    prepare(rows.sparkSession)

    @F.pandas_udf("binary")
    def digest(t):
        import pandas as pd

        return pd.Series(_digests(t.tolist()))

    return stored(rows.withColumns({"n_chars": F.length(text).cast("long"), "digest": digest(F.col(text)), "wl_pos": F.monotonically_increasing_id()}).drop(text), "prints")


def repeated_cells(prints: DataFrame, cells: int) -> np.ndarray:
    """The bitmap of cells that were hit at least twice. A batch of rows gives each cell once, with whether it hit that
    often; these meet by piece of the filter, sorted, so a task holds one piece at a time. The driver gets
    cells / 8 bytes at most."""
    schema = "piece long, cell long, often boolean"

    def hit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at, n = np.unique(_cells(b.column(0).to_pylist(), cells), return_counts=True)
            yield pa.record_batch([pa.array(at // PIECE), pa.array(at), pa.array(n > 1)], ["piece", "cell", "often"])

    def mark(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_piece, last, more = -1, -1, np.zeros(PIECE, bool)

        def closed() -> pa.RecordBatch:
            return pa.record_batch([pa.array([open_piece], pa.int64()), pa.array([np.packbits(more).tobytes()], pa.binary())], ["piece", "more"])

        for b in it:
            piece, cell, often = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            if not len(piece):
                continue
            often = often | (cell == np.concatenate([[last], cell[:-1]]))
            last = cell[-1]
            starts = np.flatnonzero(np.diff(piece, prepend=-1)).tolist()
            starts = starts if starts and not starts[0] else [0, *starts]
            for first, end in zip(starts, [*starts[1:], len(piece)], strict=True):
                if piece[first] != open_piece:
                    if more.any():
                        yield closed()
                    open_piece, more = int(piece[first]), np.zeros(PIECE, bool)
                more[cell[first:end][often[first:end]] % PIECE] = True
        if more.any():
            yield closed()

    hits = prints.select("digest").mapInArrow(hit, schema)
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = hits.repartition(parts, "piece").sortWithinPartitions("piece", "cell").mapInArrow(mark, "piece long, more binary").collect()
    out = np.zeros(cells // 8, np.uint8)
    for r in rows:
        out[r.piece * PIECE // 8 : (r.piece + 1) * PIECE // 8] |= np.frombuffer(bytes(r.more), np.uint8)
    return out


def filter_cells(rows: int) -> int:
    return min(MOST_CELLS, max(PIECE, 1 << int(CELLS * max(rows, 1) - 1).bit_length()))


def _flagged(prints: DataFrame, rows: int) -> DataFrame:
    """prints (stored) with wl_maybe: false where the digest is unique for certain."""
    cells = filter_cells(rows)
    known = prints.sparkSession.sparkContext.broadcast(repeated_cells(prints, cells))

    @F.pandas_udf("boolean")
    def maybe(digest):
        import pandas as pd

        at = _cells(digest.tolist(), cells)
        bits = known.value[at >> 3] >> (7 - (at & 7)) & 1
        return pd.Series(bits.all(axis=1).astype(bool))

    return prints.withColumn("wl_maybe", maybe("digest"))


def flagged(prints: DataFrame) -> DataFrame:
    """prints (stored) with wl_maybe. Where the largest filter would be too full, digests are dealt into slices by a
    hash, each with a filter of its own, made after one another, so that the share of false alarms never grows."""
    rows = prints.count()
    slices = -(-CELLS * rows // (2 * MOST_CELLS))
    if slices <= 1:
        return _flagged(prints, rows)
    dealt = stored(prints.withColumn("wl_slice", F.pmod(F.xxhash64("digest"), F.lit(slices))), "slices", by="wl_slice")
    own = [dealt.filter(F.col("wl_slice") == i).drop("wl_slice") for i in range(slices)]
    return reduce(DataFrame.unionByName, [stored(_flagged(s, -(-rows // slices)), "flagged") for s in own])


def decisions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row: doc_id, keep_id, group_size, kept, text_sha256."""
    prints = _hashed(docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("wl_text")), "wl_text").drop("wl_pos")
    rows = stored(flagged(prints), "flagged")
    hexed = F.lower(F.hex("digest")).alias("text_sha256")
    straight = rows.filter("not wl_maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), hexed)
    maybe = rows.filter("wl_maybe").select("doc_id", "n_chars", "digest")
    best = maybe.groupBy("digest").agg(F.min(F.struct(-F.col("n_chars"), F.col("doc_id"))).alias("wl_best"), F.count("*").alias("group_size"))
    best = stored(best.select("digest", F.col("wl_best.doc_id").alias("keep_id"), (-F.col("wl_best.col1")).alias("wl_chars"), "group_size"), "best")
    joined = salted_join(maybe, best, "digest", "group_size").select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("wl_chars"))).alias("kept"), hexed)
    return straight.unionByName(joined)


def kept_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns. Of rows that may be repeated, what decides shuffles (size, id, digest,
    number of the row); each partition sends at most one row of a group, its best so far. Of rows alike in all that
    decides, the first of their numbers stays."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("wl_row"), F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("wl_text"))
    rows = flagged(_hashed(whole, "wl_text"))
    maybe = rows.filter("wl_maybe")
    best = maybe.groupBy("digest").agg(F.min(F.struct(-F.col("n_chars"), F.col("doc_id"), F.col("wl_pos"))).alias("wl_best")).select("wl_best.wl_pos")
    return rows.filter("not wl_maybe").select("wl_row.*").unionByName(maybe.join(best.hint("merge"), "wl_pos", "left_semi").select("wl_row.*"))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return decisions(docs)
