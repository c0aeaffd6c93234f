"""A version of a tensor as its difference from another: six forms, their bytes, and their decoding against the base.

The unit is a stretch of rows, so no task holds a tensor. Sizes of patch and packed residual follow from counts, which
SQL can hold against them; what is decoded has a checksum of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators.archive import pack_residuals, unpack_residuals
from wordloom.operators.costs import residual_cost
from wordloom.operators.models import STREAM_ROWS, _ranged, _read_ranged
from wordloom.operators.stats import pair
from wordloom.plans import dialect, relations
from wordloom.plans.dialect import long

#: Mantissa bits that the later version keeps.
KEEP = 5


def later(words: np.ndarray) -> np.ndarray:
    """The words with mantissas rounded to KEEP bits, half up, carries into the exponent."""
    drop = 7 - KEEP
    exponent, m = words >> 7 & 255, ((words & 127) + (1 << drop - 1)) >> drop
    carry = m >> KEEP
    raised = exponent + carry
    low = np.where((carry == 1) | (raised == 255), 0, (m << drop) & 127)
    return np.where(exponent == 255, words, words & 0x8000 | raised << 7 | low)


def _places(mask: np.ndarray) -> bytes:
    """A list of places or a bitmap, whichever is shorter; a list of equal length."""
    at = np.flatnonzero(mask)
    width = "u1" if len(mask) <= 256 else "<u2" if len(mask) <= 65536 else "<u4"
    listed = len(at).to_bytes(4, "little") + at.astype(width).tobytes()
    bitmap = np.packbits(mask, bitorder="little").tobytes()
    return b"\0" + listed if len(listed) <= len(bitmap) else b"\1" + bitmap


def _read_places(data: bytes, n: int) -> tuple[np.ndarray, int]:
    mask = np.zeros(n, bool)
    if data[0]:
        size = -(-n // 8)
        return np.unpackbits(np.frombuffer(data, np.uint8, size, 1), bitorder="little")[:n].astype(bool), 1 + size
    width = "u1" if n <= 256 else "<u2" if n <= 65536 else "<u4"
    count = int.from_bytes(data[1:5], "little")
    mask[np.frombuffer(data, width, count, 5)] = True
    return mask, 5 + count * np.dtype(width).itemsize


def _field(base: np.ndarray, target: np.ndarray, modulus: int) -> bytes:
    """Differences of a field by XOR or by subtraction, whichever is shorter."""
    forms = [b"\0" + _ranged(base ^ target), b"\1" + _ranged((target - base) % modulus)]
    return min(forms, key=len)


def _read_field(data: bytes, base: np.ndarray, modulus: int) -> tuple[np.ndarray, int]:
    found, used = _read_ranged(data[1:], len(base))
    return ((base + found) % modulus if data[0] else base ^ found), 1 + used


def _split(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return w >> 15, w >> 7 & 255, w & 127


class Forms:
    """Each form encodes a target against a base (words, flat) and reads it back from the base."""

    @staticmethod
    def raw(base, target):
        return target.astype("<u2").tobytes()

    @staticmethod
    def read_raw(data, base):
        return np.frombuffer(data, "<u2").astype(np.int64)

    @staticmethod
    def deflated(base, target):
        return zlib.compress((base ^ target).astype("<u2").tobytes(), 9)

    @staticmethod
    def read_deflated(data, base):
        return base ^ np.frombuffer(zlib.decompress(data), "<u2").astype(np.int64)

    @staticmethod
    def ranged(base, target):
        x = base ^ target
        return _ranged(x & 255) + _ranged(x >> 8)

    @staticmethod
    def read_ranged(data, base):
        low, used = _read_ranged(data, len(base))
        high, _ = _read_ranged(data[used:], len(base))
        return base ^ (low | high << 8)

    @staticmethod
    def fields(base, target):
        (s, e, m), (t, f, n) = _split(base), _split(target)
        return _places(s != t) + _field(e, f, 256) + _field(m, n, 128)

    @staticmethod
    def read_fields(data, base):
        s, e, m = _split(base)
        flipped, at = _read_places(data, len(base))
        f, used = _read_field(data[at:], e, 256)
        n, _ = _read_field(data[at + used :], m, 128)
        return (s ^ flipped) << 15 | f << 7 | n

    @staticmethod
    def patch(base, target):
        mask = base != target
        return _places(mask) + target[mask].astype("<u2").tobytes()

    @staticmethod
    def read_patch(data, base):
        mask, at = _read_places(data, len(base))
        out = base.copy()
        out[mask] = np.frombuffer(data, "<u2", int(mask.sum()), at)
        return out

    @staticmethod
    def residual(base, target):
        return pack_residuals(base ^ target)

    @staticmethod
    def read_residual(data, base):
        return base ^ unpack_residuals(data, len(base))


NAMES = ("raw", "deflated", "ranged", "fields", "patch", "residual")


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tensor, part, form, n_words, bytes, differing, decoded_check."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            out = []
            for tensor, part, rows in zip(batch["tensor"], batch["part"], batch["rows"], strict=True):
                base = np.concatenate([np.asarray(r["ws"], np.int64) for r in rows])
                target = later(base)
                for name in NAMES:
                    data = getattr(Forms, name)(base, target)
                    back = getattr(Forms, f"read_{name}")(data, base)
                    out.append((tensor, part, name, len(base), len(data), int((back != target).sum()), int((back * (1 + np.arange(len(back)))).sum())))
            yield pd.DataFrame(out, columns=["tensor", "part", "form", "n_words", "bytes", "differing", "decoded_check"])

    rows = relations.rows(spark, sf_dir).groupBy("tensor", F.expr(f"r div {STREAM_ROWS}").alias("part")).agg(F.array_sort(F.collect_list(F.struct("r", "ws"))).alias("rows"))  # STREAM_ROWS rows at most
    return rows.mapInPandas(run, "tensor long, part long, form string, n_words long, bytes long, differing long, decoded_check long")


def delta_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each tensor and form: what is decoded, and the bytes of the forms whose size follows from counts (0 for others)."""
    known = F.when(F.col("form").isin("raw", "patch", "residual"), F.col("bytes")).otherwise(F.lit(0))
    return _coded(spark, sf_dir).groupBy("tensor", "form").agg(F.sum("n_words").alias("n_words"), F.sum(known).cast("long").alias("known_bytes"), F.sum("differing").alias("differing"), F.sum("decoded_check").alias("decoded_check"))


def delta_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each form and tensor, and of the cheapest form of each stretch."""
    got = _coded(spark, sf_dir)
    best = got.groupBy("tensor", "part").agg(F.min("bytes").alias("bytes")).select("tensor", F.lit("best").alias("form"), "bytes")
    return got.select("tensor", "form", "bytes").unionByName(best).groupBy("tensor", "form").agg(F.sum("bytes").alias("bytes"))


def _sql() -> str:
    d = dialect.DUCK
    forms = ", ".join(f"('{n}')" for n in NAMES)
    parts = f"q AS (SELECT tensor, r // {STREAM_ROWS} AS part, r % {STREAM_ROWS} * 64 + c AS pos, base, target FROM p)"
    counts = f"x AS (SELECT tensor, part, {d.xor('base', 'target')} AS res, count(*) AS n FROM q GROUP BY tensor, part, {d.xor('base', 'target')}), s AS (SELECT tensor, part, sum(n) AS n, count(*) AS k, sum(n) - max(n) AS x, sum(CASE WHEN res <> 0 THEN n ELSE 0 END) AS changed FROM x GROUP BY tensor, part)"
    width = "(CASE WHEN n <= 256 THEN 1 WHEN n <= 65536 THEN 2 ELSE 4 END)"
    sizes = f"z AS (SELECT tensor, sum(2 * n) AS raw, sum(1 + least(4 + {width} * changed, {d.div('n + 7', 8)}) + 2 * changed) AS patch, sum({residual_cost(d)}) AS residual FROM s GROUP BY tensor)"
    totals = "t AS (SELECT tensor, count(*) AS n_words, sum(target * (pos + 1)) AS decoded_check FROM q GROUP BY tensor)"
    known = "CASE fo.form WHEN 'raw' THEN z.raw WHEN 'patch' THEN z.patch WHEN 'residual' THEN z.residual ELSE 0 END"
    return f"WITH {dialect.DUCK_RELATIONS['words']}, {pair(d, KEEP)}, {parts}, {counts}, {sizes}, {totals}, fo AS (SELECT * FROM (VALUES {forms}) v(form)) SELECT t.tensor, fo.form, {long('t.n_words')} AS n_words, {long(known)} AS known_bytes, {long('0')} AS differing, {long('t.decoded_check')} AS decoded_check FROM t JOIN z ON t.tensor = z.tensor CROSS JOIN fo"


QUERIES = {f.__name__: f for f in (delta_forms, delta_bytes)}
ORACLES = {"delta_forms": _sql()}
