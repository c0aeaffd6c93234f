"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

Only lengths decide, and there are at most `capacity` of them: the plan is made from the histogram of lengths, where
equal bins are planned once with a count. Each bin is filled greedily (the largest document that fits, again and
again); then its smallest document is replaced by two unpacked ones if they fit the gap that it leaves more tightly.
Documents take the places of their length by rank, which salted windows give; no task needs all of one length.

Cases: null text counts as empty and is the end id alone; a document of over `capacity` tokens is cut into pieces of
`capacity`, of which the first may be shorter; equal rows are packed each on its own; an empty table gives no rows.
Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.llm.common import places as _binary_places
from wordloom.llm.common import prepare, stored, whole_text
from wordloom.llm.tokens import crc32_of, tokenizer

#: Pieces that share a window when ranks are given, on average.
RANKED = 250_000


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, with_ids: bool, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian unsigned, 16-bit where the
    vocabulary allows); wl_no, a number of each row."""
    prepare(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path)
        kind = "<u2" if max(tok.vocabulary, end_id + 1) <= 1 << 16 else "<u4"
        for b in it:
            ids, at = tok.encode(b.column(1))
            keep, piece, start, rows = [], [], [], []
            for i, (p, q) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                own = np.append(ids[p:q], end_id)
                first = len(own) % capacity or capacity
                cuts = [0, *range(first, len(own) + 1, capacity)]
                for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    keep.append(i)
                    piece.append(k)
                    start.append(x)
                    rows.append(own[x:y])
            out = [b.column(0).take(pa.array(keep, pa.int32())).cast(pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(r) for r in rows], pa.int64()), pa.array([crc32_of(r) for r in rows], pa.int64())]
            yield pa.record_batch(out + [pa.array([r.astype(kind).tobytes() for r in rows], pa.binary())] * with_ids, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    got = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text")).mapInArrow(run, schema)
    return got.withColumn("wl_no", F.monotonically_increasing_id())


def plan(lengths: list[int], counts: list[int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(how many bins, length to number in each) for all of the histogram."""
    left = np.zeros(capacity + 1, np.int64)
    left[lengths] = counts
    bins: list[tuple[int, dict[int, int]]] = []
    at = capacity
    while True:
        while at and not left[at]:
            at -= 1
        if not at:
            return bins
        chosen: dict[int, int] = {}
        free = capacity
        here = left[: capacity + 1].copy()
        while free:
            fit = np.flatnonzero(here[1 : free + 1])
            if not len(fit):
                break
            size = int(fit[-1]) + 1
            n = int(min(here[size], free // size))
            if len(chosen):
                n = min(n, 1)  # after the first, look again at what fits best
            n = n if size * n <= free else free // size
            chosen[size] = chosen.get(size, 0) + n
            here[size] -= n
            free -= n * size
        while free:  # best two fit
            least = min(chosen)
            gap = free + least
            sizes = np.flatnonzero(here[: gap + 1])
            sizes = sizes[sizes > 0]
            best, pair = least, (0, 0)
            partner = -np.ones(gap + 1, np.int64)  # the largest size up to each
            partner[sizes] = sizes
            partner = np.maximum.accumulate(partner)
            if len(sizes):
                mate = partner[gap - sizes]
                single = (mate == sizes) & (here[sizes] < 2)
                lower = np.where(sizes > 0, partner[np.maximum(sizes - 1, 0)], -1)
                mate = np.where(single, lower, mate)
                total = np.where(mate > 0, sizes + mate, 0)
                i = int(total.argmax())
                if total[i] > best:
                    best, pair = int(total[i]), (int(sizes[i]), int(mate[i]))
            if not pair[0]:
                break
            chosen[least] -= 1
            here[least] += 1
            if not chosen[least]:
                del chosen[least]
            for size in pair:
                chosen[size] = chosen.get(size, 0) + 1
                here[size] -= 1
            free = gap - best
        times = int(min(left[s] // n for s, n in chosen.items()))
        for s, n in chosen.items():
            left[s] -= n * times
        bins.append((times, chosen))


def places(bins: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Columns: length, first rank, ranks, bins, first sequence, offset. One row for each length of each planned bin:
    a planned bin uses up a length or halves what is left of it, and holds distinct lengths that sum to the capacity
    at most, so the rows are bounded by the capacity, not by the documents."""
    rows, rank, sequence = [], {}, 0
    for times, chosen in bins:
        offset = 0
        for size, n in sorted(chosen.items(), reverse=True):
            first = rank.get(size, 0)
            rows.append((size, first, n * times, times, sequence, offset))
            rank[size] = first + n * times
            offset += size * n
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def packed(parts: DataFrame, capacity: int) -> DataFrame:
    """parts (stored) with sequence_id and offset."""
    spark = parts.sparkSession
    histogram = parts.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most `capacity` rows
    total = sum(r.n for r in histogram)
    table = places(plan([r.length for r in histogram], [r.n for r in histogram], capacity))
    known = spark.sparkContext.broadcast(table)
    salts = max(16, -(-total // RANKED))
    cell = Window.partitionBy("length", "wl_salt")
    parts = parts.withColumn("wl_salt", F.pmod(F.xxhash64("wl_no"), F.lit(salts)))
    cells = parts.groupBy("length", "wl_salt").agg(F.count("*").alias("wl_n"))
    cells = cells.withColumn("wl_base", F.sum("wl_n").over(Window.partitionBy("length").orderBy("wl_salt").rowsBetween(Window.unboundedPreceding, -1))).select(F.col("length"), F.col("wl_salt"), F.coalesce("wl_base", F.lit(0)).alias("wl_base"))
    ranked = parts.withColumn("wl_row", F.row_number().over(cell.orderBy("wl_no")))
    ranked = ranked.join(cells, ["length", "wl_salt"]).withColumn("wl_rank", F.col("wl_base") + F.col("wl_row") - 1)

    columns = [c for c in parts.columns if c not in ("wl_no", "wl_salt")]
    fields = [f"{f.name} {'array<int>' if f.name == 'ids' else f.dataType.simpleString()}" for f in parts.select(*columns).schema]

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = known.value
        for b in it:
            size, r = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "wl_rank"))
            i = np.searchsorted(t[:, 0] * (1 << 44) + t[:, 1], size * (1 << 44) + r, "right") - 1
            within, times = r - t[i, 1], t[i, 3]
            own = {c: b.column(b.schema.get_field_index(c)) for c in columns}
            if "ids" in own:
                at, n = map(np.array, _binary_places(own["ids"]))
                width = int(n[0] // size[0]) if len(n) else 2
                flat = np.frombuffer(own["ids"].buffers()[2], f"<u{width}", int(n.sum()) // width, int(at[0])) if len(n) else np.zeros(0, "<u2")
                own["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(flat.astype(np.int32)))
            yield pa.record_batch([*own.values(), pa.array(t[i, 4] + within % times), pa.array(t[i, 5] + within // times * size)], [*own, "sequence_id", "offset"])

    return ranked.select(*columns, "wl_rank").mapInArrow(place, ", ".join([*fields, "sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048, with_ids: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    return packed(stored(pieces(docs, tokenizer_path, end_id, capacity, with_ids, doc_id, text), "pieces"), capacity)


def query(spark: SparkSession, docs: DataFrame, tokenizer_path: str) -> DataFrame:
    return pack_documents(docs, tokenizer_path, with_ids=False).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
