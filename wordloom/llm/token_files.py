"""Token-id files: canonical length-limited Huffman codes of ids, in blocks that decode on their own.

A file is the list of its blocks; a block is one binary value:

    magic "WLH1", then little-endian uint32: documents, tokens, checkpoint stride, bits of payload, longest code,
    symbols; uint64: tokens of the file before this block;
    symbols x (uint32 id, uint8 code length); documents x (uint8 has id, int64 id, uint32 tokens);
    checkpoints x uint32 bit offset, one for every `stride` tokens; payload, most significant bit first.

Code lengths are global, from counts over all documents, and each block names those it uses: codes are canonical over
the whole table, so the block carries (id, length, code) of its own ids only and needs no other file. The checkpoints
let one block be decoded in many places at once: all stretches advance together, one table look-up a step.
Blocks are rows of a Parquet data set written by Spark's committer, so that any store will do and a lost executor's
half-written files never count. Documents are in ascending order of id: the order of files, blocks, and within blocks.

Cases: a null text counts as empty and yields the end id alone; a null id sorts first; rows that repeat an id stand in
the order of their ids' crc32 and count; an empty table gives no file. Other columns of the input are not read.
"""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import prepare, stored, whole_text
from wordloom.llm.tokens import crc32_of, tokenizer

MAGIC = b"WLH1"
HEAD = struct.Struct("<4s6IQ")
#: Tokens between two checkpoints, and tokens after which a block ends with the document at hand.
STRIDE, BLOCK = 512, 1 << 18
#: Longest code; it grows only with the vocabulary.
LONGEST = 16


def code_lengths(counts: np.ndarray, longest: int) -> np.ndarray:
    """Package-merge: lengths of at most `longest` bits of a prefix code that costs the fewest bits. counts are over 0."""
    n = len(counts)
    if n == 1:
        return np.ones(1, np.int64)
    if n > 1 << longest:
        raise ValueError("more symbols than codes of this length")
    order = np.argsort(counts, kind="stable")
    weights = counts[order].astype(np.int64)
    rounds, merged = [], weights
    for _ in range(longest - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        at = np.argsort(both, kind="stable")
        rounds.append(at < n)
        merged = both[at]
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for single in reversed(rounds):
        leaves = int(single[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[:take] += 1
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


def canonical(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, id)."""
    order = np.lexsort((ids, lengths))
    codes = np.zeros(len(ids), np.int64)
    code = last = 0
    for i in order.tolist():
        n = int(lengths[i])
        code <<= n - last
        codes[i], last = code, n
        code += 1
    return codes


class Code:
    """Codes by id, for writing."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        self.longest = int(lengths.max())
        size = int(ids.max()) + 1
        self.length, self.code = np.zeros(size, np.uint8), np.zeros(size, np.uint32)
        self.length[ids], self.code[ids] = lengths, canonical(ids, lengths)


def write_block(code: Code, doc_ids: list[int | None], sizes: list[int], ids: np.ndarray, before: int) -> bytes:
    lengths = code.length[ids].astype(np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    bits = int(ends[-1]) if len(ends) else 0
    word, shift = starts >> 5, 64 - (starts & 31) - lengths
    spread = code.code[ids].astype(np.uint64) << shift.astype(np.uint64)
    room = (bits >> 5) + 2
    high = np.bincount(word, (spread >> np.uint64(32)).astype(np.float64), room).astype(np.uint64)
    low = np.bincount(word + 1, (spread & np.uint64(0xFFFFFFFF)).astype(np.float64), room).astype(np.uint64)
    payload = (high + low).astype(">u4").tobytes()[: (bits + 7) // 8]
    used = np.flatnonzero(np.bincount(ids, minlength=len(code.length)))
    symbols = np.zeros(len(used), "<u4,u1,<u4")
    symbols["f0"], symbols["f1"], symbols["f2"] = used, code.length[used], code.code[used]
    index = np.zeros(len(doc_ids), "u1,<i8,<u4")
    index["f0"] = [d is not None for d in doc_ids]
    index["f1"], index["f2"] = [d or 0 for d in doc_ids], sizes
    marks = starts[::STRIDE].astype("<u4")
    head = HEAD.pack(MAGIC, len(doc_ids), len(ids), STRIDE, bits, code.longest, len(used), before)
    return head + symbols.tobytes() + index.tobytes() + marks.tobytes() + payload


def read_block(block: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of the file before the block; documents (has id, id, tokens); ids one after another; where documents begin."""
    magic, docs, tokens, stride, bits, longest, symbols, before = HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    at = HEAD.size
    table = np.frombuffer(block, "<u4,u1,<u4", symbols, at)
    index = np.frombuffer(block, "u1,<i8,<u4", docs, at := at + table.nbytes)
    marks = np.frombuffer(block, "<u4", -(-tokens // stride), at := at + index.nbytes).astype(np.int64)
    payload = np.frombuffer(block, np.uint8, offset=at + 4 * len(marks))
    if len(payload) != (bits + 7) // 8 or index["f2"].sum() != tokens:
        raise ValueError("a block of token ids is cut short")
    # one look-up table entry for each `longest` bits: id and bits of the code
    entry = np.zeros(1 << longest, np.uint64)
    order = np.lexsort((table["f0"], table["f1"]))
    size = np.left_shift(1, longest - table["f1"][order].astype(np.int64))
    first = table["f2"][order].astype(np.int64) << (longest - table["f1"][order].astype(np.int64))
    fill = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    entry[fill] = np.repeat(table["f0"][order].astype(np.uint64) << np.uint64(8) | table["f1"][order], size)
    # the last stretch may run on into zeros, for as many tokens as the others have; these are cut off
    padded = np.concatenate([payload, np.zeros(stride * longest // 8 + 16, np.uint8)])
    eights = np.ndarray(len(padded) - 7, ">u8", padded, strides=(1,))
    out = np.zeros((stride, len(marks)), np.uint32)
    place, steps = marks.copy(), min(stride, tokens)
    # of 64 bits at a byte, at least 57 are at and after the place: so many whole codes are taken from one load
    at_once, down = 57 // longest, np.uint64(64 - longest)
    for step in range(0, steps, at_once):
        ahead = eights[place >> 3].astype(np.uint64) << (place & 7).astype(np.uint64)
        for now in range(step, min(step + at_once, steps)):
            got = entry[ahead >> down]
            out[now] = got >> np.uint64(8)
            got &= np.uint64(255)
            ahead <<= got
            place += got.view(np.int64)
    ids = out.T.reshape(-1)[:tokens]
    return before, index, ids, np.concatenate([[0], np.cumsum(index["f2"])]).astype(np.int64)


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned, 16-bit where the vocabulary allows), crc (of ids, for order); and,
    where n_tokens is null, the counts of a partition's ids: `ids` holds these, `times` how often (uint64)."""
    prepare(docs.sparkSession)
    names = ["doc_id", "n_tokens", "ids", "crc", "times"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path)
        size = max(tok.vocabulary, end_id + 1)
        kind, total = "<u2" if size <= 1 << 16 else "<u4", np.zeros(size, np.int64)
        for b in it:
            ids, at = tok.encode(b.column(1))
            ids, at = np.insert(ids, at[1:], end_id), at + np.arange(len(at))
            total += np.bincount(ids, minlength=size)
            crc = [crc32_of(ids[p:q]) for p, q in itertools.pairwise(at.tolist())]
            values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(b), [None, pa.py_buffer(at * np.dtype(kind).itemsize), pa.py_buffer(ids.astype(kind))])
            yield pa.record_batch([b.column(0).cast(pa.int64()), pa.array(np.diff(at)), values.cast(pa.binary()), pa.array(crc, pa.int64()), pa.nulls(len(b), pa.binary())], names)
        used = np.flatnonzero(total)
        if len(used):
            yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([used.astype("<u4").tobytes()], pa.binary()), pa.nulls(1, pa.int64()), pa.array([total[used].astype("<u8").tobytes()], pa.binary())], names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary, crc long, times binary")


def _words(value: bytes, n: int) -> np.ndarray:
    return np.frombuffer(value, "<u2" if len(value) == 2 * n else "<u4")


def global_counts(tokens: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and their counts over all documents. At most as many rows as the vocabulary has come to the driver."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for ids, times in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.record_batch([pa.array(np.frombuffer(ids, "<u4").astype(np.int64)), pa.array(np.frombuffer(times, "<u8").astype(np.int64))], ["id", "n"])

    counts = tokens.filter("times is not null").select("ids", "times")
    rows = counts.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").toPandas()
    return rows["id"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


def written(tokens: DataFrame, files: int | None = None) -> DataFrame:
    """tokens: of `encoded`, stored. Write the files; returns their blocks as read back: file_no, block_no, n_docs, n_tokens, block."""
    spark = tokens.sparkSession
    ids, counts = global_counts(tokens)
    if not len(ids):
        return spark.createDataFrame([], "file_no long, block_no long, n_docs long, n_tokens long, block binary")
    longest = max(LONGEST, int(len(ids) - 1).bit_length() + 1)
    code = spark.sparkContext.broadcast(Code(ids, code_lengths(counts, longest)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file_no, block_no, before = TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        held: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal block_no, before
            all_ids = np.concatenate(held).astype(np.int64)
            value = write_block(code.value, docs, [len(h) for h in held], all_ids, before)
            out = pa.record_batch([pa.array([file_no], pa.int64()), pa.array([block_no], pa.int64()), pa.array([len(docs)], pa.int64()), pa.array([len(all_ids)], pa.int64()), pa.array([value], pa.binary())], ["file_no", "block_no", "n_docs", "n_tokens", "block"])
            block_no, before = block_no + 1, before + len(all_ids)
            docs.clear()
            held.clear()
            return out

        size = 0
        for b in it:
            for d, n, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                docs.append(d)
                held.append(_words(value, n))
                size += n
                if size >= BLOCK:
                    yield close()
                    size = 0
        if docs:
            yield close()

    files = files or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = ["doc_id", "crc", "n_tokens"]
    ordered = tokens.filter("n_tokens is not null").select("doc_id", "n_tokens", "ids", "crc").repartitionByRange(files, *[F.col(k).asc_nulls_first() for k in keys]).sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in keys])
    return stored(ordered.select("doc_id", "n_tokens", "ids").mapInArrow(run, "file_no long, block_no long, n_docs long, n_tokens long, block binary"), "token-files", "none")


def read_documents(blocks: DataFrame, with_ids: bool = True) -> DataFrame:
    """Decode the blocks: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ids."""
    spark = blocks.sparkSession
    sizes = blocks.groupBy("file_no").agg(F.sum("n_tokens").alias("n")).orderBy("file_no").collect()  # one row a file
    starts, total = {}, 0
    for row in sizes:
        starts[row.file_no], total = total, total + row.n
    where = spark.sparkContext.broadcast(starts)
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for file_no, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                before, index, ids, at = read_block(value)
                rows = [ids[p:q] for p, q in zip(at[:-1], at[1:], strict=True)]
                out = [pa.array(index["f1"], pa.int64(), mask=index["f0"] == 0), pa.array(at[:-1] + (where.value[file_no] + before), pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array([crc32_of(r) for r in rows], pa.int64())]
                if with_ids:
                    out.append(pa.array(rows, pa.list_(pa.uint32())).cast(pa.list_(pa.int64())))
                yield pa.record_batch(out, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return blocks.select("file_no", "block").mapInArrow(run, schema)


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int, doc_id: str = "doc_id", text: str = "text", files: int | None = None) -> DataFrame:
    """Tokenise, count, write; returns the blocks that were written (see read_documents)."""
    return written(stored(encoded(docs, tokenizer_path, end_id, doc_id, text), "token-ids"), files)


def query(spark: SparkSession, docs: DataFrame, tokenizer_path: str) -> DataFrame:
    return read_documents(token_files(docs, tokenizer_path, 2), with_ids=False)
