"""Files of encoded tensors: tiles behind a JSON header, versions against a base, aligned sections, raw words beside a
manifest, and four-bit groups.

All begin with four letters, a version and the length of a JSON header, little-endian; what is cut short, has bytes left
over or fails its checksum is refused. The functions work on bytes, so that tasks can write one file a tensor and any
store holds them; `write_tensors` and `read_tensors` do that over Spark, with an index beside the files.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from wordloom.operators.archive import decode_tile

VERSION = 1
PREFIX = struct.Struct("<4sHI")
#: Number of the encoding, rows, columns, first row, first column, bytes of payload: the 17 bytes that a tile costs.
TILE = struct.Struct("<BHHIII")
TILES, DELTAS, SECTIONS, GROUPS = b"WLTC", b"WLDC", b"WLSC", b"WLI4"
ALIGN = 64


@dataclass(frozen=True)
class Tile:
    mode: int
    rows: int
    cols: int
    row0: int
    col0: int
    payload: bytes


def _framed(magic: bytes, header: dict) -> bytes:
    text = json.dumps(header, separators=(",", ":"), sort_keys=True).encode()
    return PREFIX.pack(magic, VERSION, len(text)) + text


def read_frame(data: bytes, magic: bytes) -> tuple[dict, int]:
    """The header, and where the body begins."""
    if len(data) < PREFIX.size:
        raise ValueError("a container is cut short")
    own, version, size = PREFIX.unpack_from(data)
    if own != magic or version != VERSION or len(data) < PREFIX.size + size:
        raise ValueError("not a container of this kind")
    return json.loads(data[PREFIX.size : PREFIX.size + size]), PREFIX.size + size


def dump_tiles(tensors: list[tuple[dict, list[Tile]]], extra: dict | None = None) -> bytes:
    """tensors: what the header says of each (name, shape and so on), and its tiles in order."""
    header = {"tensors": [about | {"n_tiles": len(tiles)} for about, tiles in tensors], "extra": extra or {}}
    body = b"".join(TILE.pack(t.mode, t.rows, t.cols, t.row0, t.col0, len(t.payload)) + t.payload for _, tiles in tensors for t in tiles)
    return _framed(TILES, header) + body


def iterate_tiles(data: bytes) -> Iterator[Tile]:
    """All tiles one after another, without a look at the header's text."""
    own, version, size = PREFIX.unpack_from(data)
    if own != TILES or version != VERSION:
        raise ValueError("not a container of this kind")
    at = PREFIX.size + size
    while at < len(data):
        if at + TILE.size > len(data):
            raise ValueError("a tile's header is cut short")
        *about, n = TILE.unpack_from(data, at)
        at += TILE.size
        if at + n > len(data):
            raise ValueError("a tile's payload is cut short")
        yield Tile(*about, data[at : at + n])
        at += n


def load_tiles(data: bytes) -> tuple[list[tuple[dict, list[Tile]]], dict]:
    header, _ = read_frame(data, TILES)
    tiles = list(iterate_tiles(data))
    if len(tiles) != sum(t["n_tiles"] for t in header["tensors"]):
        raise ValueError("a container has another number of tiles than its header says")
    out, at = [], 0
    for about in header["tensors"]:
        out.append((about, tiles[at : at + about["n_tiles"]]))
        at += about["n_tiles"]
    return out, header["extra"]


def dump_deltas(tensors: list[tuple[dict, bytes]], extra: dict | None = None) -> bytes:
    """tensors: what the header says of each (name, form, shape), and its payload against the base."""
    header = {"tensors": [about | {"payload_len": len(p)} for about, p in tensors], "extra": extra or {}}
    return _framed(DELTAS, header) + b"".join(p for _, p in tensors)


def load_deltas(data: bytes) -> tuple[list[tuple[dict, bytes]], dict]:
    header, at = read_frame(data, DELTAS)
    out = []
    for about in header["tensors"]:
        out.append((about, data[at : at + about["payload_len"]]))
        at += about["payload_len"]
    if at != len(data):
        raise ValueError("a container is cut short or has bytes left over")
    return out, header["extra"]


def delta_size(abouts: list[dict], sizes: list[int], extra: dict | None = None) -> int:
    """Complete bytes of the container, from the sizes of its payloads."""
    return len(_framed(DELTAS, {"tensors": [a | {"payload_len": n} for a, n in zip(abouts, sizes, strict=True)], "extra": extra or {}})) + sum(sizes)


def dump_sections(sections: dict[str, bytes], meta: dict | None = None) -> bytes:
    """Named sections, each at a multiple of ALIGN, with absolute places and checksums in the header."""

    def header(first: int) -> bytes:
        at, places = first, {}
        for name, body in sections.items():
            places[name] = {"at": at, "size": len(body), "crc32": zlib.crc32(body)}
            at += -(-len(body) // ALIGN) * ALIGN
        return _framed(SECTIONS, {"sections": places, "meta": meta or {}})

    first = ALIGN
    while len(header(first)) > first:  # places in the text make it longer
        first += ALIGN
    out = bytearray(header(first).ljust(first, b"\0"))
    for body in sections.values():
        out += body.ljust(-(-len(body) // ALIGN) * ALIGN, b"\0")
    return bytes(out)


def read_section(data: bytes, name: str) -> bytes:
    header, _ = read_frame(data, SECTIONS)
    place = header["sections"][name]
    body = data[place["at"] : place["at"] + place["size"]]
    if len(body) != place["size"] or zlib.crc32(body) != place["crc32"]:
        raise ValueError(f"section {name} is corrupt")
    return body


def section_names(data: bytes) -> list[str]:
    return list(read_frame(data, SECTIONS)[0]["sections"])


#: Values that share a scale.
GROUP = 64


def dump_int4(values: np.ndarray) -> bytes:
    """Floats in groups of GROUP: a half-precision scale each (the largest magnitude over 7) and codes of four bits."""
    flat = np.asarray(values, np.float32).reshape(-1)
    groups = np.zeros((-(-len(flat) // GROUP), GROUP), np.float32)
    groups.reshape(-1)[: len(flat)] = flat
    scale = np.maximum(np.abs(groups).max(axis=1, initial=0) / 7, 1e-8).astype("<f2")
    wide = np.maximum(scale.astype(np.float32), np.float32(6e-8))[:, None]
    codes = (np.clip(np.rint(groups / wide), -8, 7).astype(np.int64) & 15).reshape(-1)
    packed = (codes[0::2] | codes[1::2] << 4).astype(np.uint8)
    return _framed(GROUPS, {"shape": list(np.shape(values)), "group": GROUP}) + scale.tobytes() + packed.tobytes()


def load_int4(data: bytes) -> np.ndarray:
    header, at = read_frame(data, GROUPS)
    n = int(np.prod(header["shape"], dtype=np.int64))
    groups = -(-n // header["group"])
    scale = np.frombuffer(data, "<f2", groups, at).astype(np.float32)
    packed = np.frombuffer(data, np.uint8, groups * header["group"] // 2, at + 2 * groups).astype(np.int64)
    if at + 2 * groups + len(packed) != len(data):
        raise ValueError("a container is cut short or has bytes left over")
    codes = np.stack([packed & 15, packed >> 4], axis=1).reshape(groups, header["group"])
    return (((codes ^ 8) - 8) * scale[:, None]).astype(np.float32).reshape(-1)[:n].reshape(header["shape"])


def dump_words(words: np.ndarray, about: dict) -> tuple[bytes, str]:
    """Raw words, and a manifest with their shape and checksum."""
    body = np.asarray(words).astype("<u2").tobytes()
    return body, json.dumps(about | {"shape": list(np.shape(words)), "byte_count": len(body), "sha256": hashlib.sha256(body).hexdigest()}, sort_keys=True)


def load_words(body: bytes, manifest: str) -> np.ndarray:
    about = json.loads(manifest)
    if len(body) != about["byte_count"] or hashlib.sha256(body).hexdigest() != about["sha256"]:
        raise ValueError("words are not those of their manifest")
    return np.frombuffer(body, "<u2").reshape(about["shape"])


def write_tensors(archive: DataFrame, path: str) -> None:
    """archive (tiles of operators.archive.compress) to rows of one container a tensor, with what an index says of it.
    A tensor's container is one value, so a task holds one tensor; larger ones stay a table of tiles."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("tile")
        rows_before = np.concatenate([[0], np.cumsum(part["n_rows"])[:-1]]).astype(int)
        tiles = [Tile(int(m), int(h), int(w), int(r), 0, p) for m, h, w, r, p in zip(part["mode_id"], part["n_rows"], part["n_cols"], rows_before, part["payload"], strict=True)]
        about = {"name": str(part["tensor"].iloc[0]), "shape": [int(part["n_rows"].sum()), int(part["n_cols"].max())], "modes": part["mode_name"].tolist()}
        data = dump_tiles([(about, tiles)])
        return pd.DataFrame({"tensor": [int(part["tensor"].iloc[0])], "n_words": [int((part["n_rows"] * part["n_cols"]).sum())], "size": [len(data)], "sha256": [hashlib.sha256(data).hexdigest()], "container": [data]})

    archive.groupBy("tensor").applyInPandas(run, "tensor long, n_words long, size long, sha256 string, container binary").write.mode("errorifexists").parquet(path)


def index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("tensor", "n_words", "size", "sha256").orderBy("tensor")


def read_tensors(spark: SparkSession, path: str) -> DataFrame:
    """rows (tensor, r, ws) of the containers; one whose checksum is wrong is refused."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            for tensor, sha, data in zip(batch["tensor"], batch["sha256"], batch["container"], strict=True):
                if hashlib.sha256(data).hexdigest() != sha:
                    raise ValueError(f"the container of tensor {tensor} is corrupt")
                for about, tiles in load_tiles(data)[0]:
                    for tile, mode in zip(tiles, about["modes"], strict=True):
                        words = decode_tile(mode, tile.payload, tile.rows, tile.cols)
                        yield pd.DataFrame({"tensor": tensor, "r": tile.row0 + np.arange(tile.rows), "ws": list(words)})

    return spark.read.parquet(path).select("tensor", "sha256", "container").mapInPandas(run, "tensor long, r long, ws array<long>")


assert TILE.size == 17  # a tile's price counts on it
