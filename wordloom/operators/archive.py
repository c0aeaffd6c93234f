"""Compress, decompress and verify: tiles of words to the bytes of the cheapest encoding, and back.

The bytes of a tile are as many as `costs` prices, so the chooser's sums are those of the archive. A row of the archive
is a tile: tensor, tile, mode, rows, cols, payload, and the crc32 of its payload. Tiles decode on their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.entropy import pack_bits, unpack_fixed
from wordloom.operators.costs import HEADER, MODES
from wordloom.plans import dialect, relations

ROWS = 4
SCHEMA = "tensor long, tile long, mode_id long, mode_name string, n_rows int, n_cols int, payload binary, crc long"


def _bits(k: int) -> int:
    return 0 if k <= 1 else int(k - 1).bit_length()


def _indexes(palette: np.ndarray, values: np.ndarray) -> bytes:
    return pack_bits(np.searchsorted(palette, values), np.full(len(values), _bits(len(palette))))


def _width(n: int) -> int:
    return 1 if n <= 256 else 2 if n <= 65536 else 4


def pack_residuals(r: np.ndarray) -> bytes:
    """The shortest of: as they are, one value, exceptions by place, exceptions by bitmap, a palette of up to four."""
    values, counts = np.unique(r, return_counts=True)
    n, k = len(r), len(values)
    default = values[counts.argmax()]
    odd = r != default
    x, word = int(odd.sum()), np.uint16(default).tobytes()
    forms = [bytes([0]) + r.astype("<u2").tobytes()]
    if k == 1:
        forms.append(bytes([1]) + word)
    places = np.flatnonzero(odd).astype(f"<u{_width(n)}").tobytes()
    forms.append(bytes([2]) + word + x.to_bytes(4, "little") + places + r[odd].astype("<u2").tobytes())
    forms.append(bytes([3]) + word + np.packbits(odd, bitorder="little").tobytes() + r[odd].astype("<u2").tobytes())
    if 2 <= k <= 4:
        forms.append(bytes([4]) + k.to_bytes(2, "little") + values.astype("<u2").tobytes() + _indexes(values, r))
    return min(forms, key=len)


def unpack_residuals(data: bytes, n: int) -> np.ndarray:
    kind, body = data[0], data[1:]
    if kind == 0:
        return np.frombuffer(body, "<u2").astype(np.int64)
    if kind == 4:
        k = int.from_bytes(body[:2], "little")
        values = np.frombuffer(body, "<u2", k, 2).astype(np.int64)
        return values[unpack_fixed(body[2 + 2 * k :], _bits(k), n)]
    out = np.full(n, int.from_bytes(body[:2], "little"), np.int64)
    if kind == 2:
        x, w = int.from_bytes(body[2:6], "little"), _width(n)
        out[np.frombuffer(body, f"<u{w}", x, 6).astype(np.int64)] = np.frombuffer(body, "<u2", x, 6 + w * x)
    elif kind == 3:
        mask = np.unpackbits(np.frombuffer(body, np.uint8, (n + 7) // 8, 2), bitorder="little")[:n].astype(bool)
        out[mask] = np.frombuffer(body, "<u2", int(mask.sum()), 2 + (n + 7) // 8)
    elif kind != 1:
        raise ValueError(f"residuals of unknown kind {kind}")
    return out


def encode_tile(words: np.ndarray) -> tuple[str, bytes]:
    """words: rows x cols. The shortest payload; ties to the lower number of the mode."""
    flat, n = words.reshape(-1), words.size
    values, counts = np.unique(flat, return_counts=True)
    forms = {"raw": flat.astype("<u2").tobytes()}
    if len(values) == 1:
        forms["constant"] = np.uint16(values[0]).tobytes()
    if 2 <= len(values) <= 16:
        forms["value_dict"] = len(values).to_bytes(2, "little") + values.astype("<u2").tobytes() + _indexes(values, flat)
    exponents, rest = flat >> 7 & 255, (flat >> 8 & 128) | flat & 127
    palette = np.unique(exponents)
    head = bytes([1 < len(palette) <= 16]) + n.to_bytes(4, "little") + rest.astype(np.uint8).tobytes()
    tail = len(palette).to_bytes(2, "little") + palette.astype(np.uint8).tobytes() + _indexes(palette, exponents) if head[0] else exponents.astype(np.uint8).tobytes()
    forms["components"] = head + tail
    for name in ("value_dict", "components"):
        if len(forms.get(name, b"")) >= 2 * n:
            del forms[name]
    forms["prev_value"] = pack_residuals(flat ^ np.concatenate([[0], flat[:-1]]))
    forms["prev_row"] = pack_residuals((words ^ np.concatenate([np.zeros_like(words[:1]), words[:-1]])).reshape(-1))
    mode = values[counts.argmax()]
    forms["const_pred"] = np.uint16(mode).tobytes() + pack_residuals(flat ^ mode)
    name = min(forms, key=lambda f: (len(forms[f]), MODES[f]))
    return name, forms[name]


def decode_tile(name: str, payload: bytes, rows: int, cols: int) -> np.ndarray:
    n = rows * cols
    if name == "raw":
        out = np.frombuffer(payload, "<u2").astype(np.int64)
    elif name == "constant":
        out = np.full(n, int.from_bytes(payload, "little"), np.int64)
    elif name == "value_dict":
        k = int.from_bytes(payload[:2], "little")
        out = np.frombuffer(payload, "<u2", k, 2).astype(np.int64)[unpack_fixed(payload[2 + 2 * k :], _bits(k), n)]
    elif name == "components":
        rest, body = np.frombuffer(payload, np.uint8, n, 5).astype(np.int64), payload[5 + n :]
        if payload[0]:
            k = int.from_bytes(body[:2], "little")
            exponents = np.frombuffer(body, np.uint8, k, 2).astype(np.int64)[unpack_fixed(body[2 + k :], _bits(k), n)]
        else:
            exponents = np.frombuffer(body, np.uint8).astype(np.int64)
        out = (rest & 128) << 8 | exponents << 7 | rest & 127
    elif name == "prev_value":
        out = np.bitwise_xor.accumulate(unpack_residuals(payload, n))
    elif name == "prev_row":
        out = np.bitwise_xor.accumulate(unpack_residuals(payload, n).reshape(rows, cols), axis=0)
    elif name == "const_pred":
        out = unpack_residuals(payload[2:], n) ^ int.from_bytes(payload[:2], "little")
    else:
        raise ValueError(f"tile of unknown mode {name}")
    if out.size != n:
        raise ValueError("a tile has another number of words")
    return out.reshape(rows, cols)


def compress(rows: DataFrame) -> DataFrame:
    """rows (tensor, r, ws) to tiles of ROWS rows."""
    tiles = rows.groupBy("tensor", F.expr(f"r div {ROWS}").alias("tile")).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "ws"))), lambda x: x.ws).alias("ws"))  # ROWS rows at most

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            out = []
            for tensor, tile, ws in zip(batch["tensor"], batch["tile"], batch["ws"], strict=True):
                words = np.stack([np.asarray(w, np.int64) for w in ws])
                name, payload = encode_tile(words)
                out.append((tensor, tile, MODES[name], name, *words.shape, payload, zlib.crc32(payload)))
            yield pd.DataFrame(out, columns=["tensor", "tile", "mode_id", "mode_name", "n_rows", "n_cols", "payload", "crc"])

    return tiles.mapInPandas(run, SCHEMA)


def decompress(archive: DataFrame) -> DataFrame:
    """tiles to rows (tensor, r, ws). A payload that is not as it was written is refused."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            out = []
            for t in batch.itertuples():
                if zlib.crc32(t.payload) != t.crc:
                    raise ValueError(f"tile {t.tile} of tensor {t.tensor} is corrupt")
                words = decode_tile(t.mode_name, t.payload, t.n_rows, t.n_cols)
                out += [(t.tensor, t.tile * ROWS + i, w) for i, w in enumerate(words)]
            yield pd.DataFrame(out, columns=["tensor", "r", "ws"])

    return archive.mapInPandas(run, "tensor long, r long, ws array<long>")


def verified(rows: DataFrame, back: DataFrame) -> DataFrame:
    """tensor, n_words, differing: rows against rows by place."""
    joined = rows.select("tensor", "r", F.col("ws").alias("a")).join(back.select("tensor", "r", F.col("ws").alias("b")), ["tensor", "r"], "full")
    apart = F.when(F.col("a").isNull() | F.col("b").isNull() | (F.size("a") != F.size("b")), F.size(F.coalesce("a", "b"))).otherwise(F.size(F.filter(F.zip_with("a", "b", lambda x, y: x != y), lambda z: z)))
    return joined.groupBy("tensor").agg(F.sum(F.size(F.coalesce("a", "b"))).cast("long").alias("n_words"), F.sum(apart).cast("long").alias("differing"))


def archive_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the decoded archive by number and by a sum over places, and how many differ from what went in."""
    rows = relations.rows(spark, sf_dir).select("tensor", "r", "ws")
    back = decompress(compress(rows))
    check = back.select("tensor", F.aggregate(F.transform("ws", lambda w, c: w * (F.col("r") * 64 + c + 1)), F.lit(0).cast("long"), lambda a, x: a + x).alias("s")).groupBy("tensor").agg(F.sum("s").alias("decoded_check"))
    return verified(rows, back).join(check, "tensor")


def archive_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each tile, header and all: equal to what the chooser prices."""
    tiles = compress(relations.rows(spark, sf_dir).select("tensor", "r", "ws"))
    return tiles.select("tensor", "tile", "mode_id", "mode_name", (F.lit(HEADER) + F.length("payload")).cast("long").alias("bytes"))


QUERIES = {"archive_roundtrip": archive_roundtrip, "archive_sizes": archive_sizes}
ORACLES = {
    "archive_roundtrip": f"WITH {dialect.DUCK_RELATIONS['words']} SELECT tensor, CAST(count(*) AS BIGINT) AS n_words, CAST(0 AS BIGINT) AS differing, CAST(sum(w * (r * 64 + c + 1)) AS BIGINT) AS decoded_check FROM words GROUP BY tensor",
    "archive_sizes": dialect.render("codec_argmin", dialect.DUCK),
}
