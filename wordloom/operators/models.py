"""Mantissas coded under models of what stands before them, read back place by place; and exponents in the cheapest of
five forms.

A model is fitted on a bounded sample: rows of up to SAMPLE words, those with the least hash. Its streams are rows, all
rows of a batch advance together, and decoding works out the model's features from what is decoded already.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import binary, entropy, mantissa
from wordloom.plans import dialect, relations

#: Rows of the sample that a model is fitted on.
SAMPLE = 2048


def sample(spark: SparkSession, sf_dir: str) -> np.ndarray:
    """Words of up to SAMPLE rows, those with the least hash of tensor and row."""
    rows = relations.rows(spark, sf_dir).select("tensor", "r", "ws").orderBy(F.xxhash64("tensor", "r"), "tensor", "r").limit(SAMPLE).collect()
    return np.array([r.ws for r in rows], np.int64)


class Coder:
    """Bit probabilities of a model for whole rows, and place by place as decoding needs them."""

    def __init__(self, kind: str, words: np.ndarray):
        self.kind = kind
        if kind == "contexts":
            self.model = mantissa.Contexts.fitted(words & 127)
        else:
            x, y = mantissa.row_features(words).reshape(-1, 4), (words & 127).reshape(-1)
            self.model = (mantissa.Trees if kind == "trees" else mantissa.Network).fitted(x, y)

    def encode(self, words: np.ndarray) -> list[bytes]:
        m = words & 127
        bits = mantissa.bits_of(m)
        if self.kind == "contexts":
            p = self.model.probabilities(self.model._context(m, self.model.depth))
        elif self.kind == "trees":
            p = self.model.probabilities(mantissa.row_features(words).reshape(-1, 4)).reshape(bits.shape)
        else:
            classes = self.model.classes(mantissa.row_features(words).reshape(-1, 4))
            flat = m.reshape(-1)
            p = np.stack([mantissa.bit_given_prefix(classes, b, flat >> (mantissa.WIDTH - b)) for b in range(mantissa.WIDTH)], axis=1).reshape(bits.shape)
        shape = (len(words), -1)
        return binary.encode(bits.reshape(shape), binary.frequencies(p).reshape(shape))

    def decode(self, streams: list[bytes], high: np.ndarray) -> np.ndarray:
        """high: words without their mantissas."""
        reader, out = binary.Decoder(streams), np.zeros_like(high)
        for k in range(high.shape[1]):
            before, earlier = (out[:, k - by] if k >= by else np.zeros(len(out), np.int64) for by in (1, 2))
            if self.kind == "contexts":
                context = np.zeros((len(out), mantissa.WIDTH), np.int64)
                for by in range(1, self.model.depth + 1):
                    if k >= by:
                        context |= mantissa.bits_of(out[:, k - by]) << (by - 1)
                p = self.model.probabilities(context)
            else:
                x = mantissa.features(high[:, k] >> 15, high[:, k] >> 7 & 255, before, earlier)
                known = self.model.probabilities(x) if self.kind == "trees" else self.model.classes(x)
            value = np.zeros(len(out), np.int64)
            for b in range(mantissa.WIDTH):
                own = mantissa.bit_given_prefix(known, b, value) if self.kind == "network" else (p if self.kind == "contexts" else known)[:, b]
                value = value << 1 | reader.next(binary.frequencies(own))
            out[:, k] = value
        reader.close()
        return out


def _stacked(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(w, np.int64) for w in column])


def _coded(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """tensor, n_words, payload_bytes, differing, decoded_check."""
    words = sample(spark, sf_dir)
    known = spark.sparkContext.broadcast(Coder(kind, words) if len(words) else None)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            if len(batch):
                words = _stacked(batch["ws"])
                streams = known.value.encode(words)
                back = known.value.decode(streams, words & ~np.int64(127))
                yield pd.DataFrame({"tensor": batch["tensor"], "n_words": words.shape[1], "payload_bytes": [len(s) for s in streams], "differing": (back != words & 127).sum(axis=1), "decoded_check": (back * (1 + np.arange(back.shape[1]))).sum(axis=1)})

    got = relations.rows(spark, sf_dir).select("tensor", "ws").mapInPandas(run, "tensor long, n_words long, payload_bytes long, differing long, decoded_check long")
    return got.groupBy("tensor").agg(*[F.sum(c).alias(c) for c in ("n_words", "payload_bytes", "differing", "decoded_check")])


def tree_mantissas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mantissas under boosted trees, a model for each bit."""
    return _coded(spark, sf_dir, "trees").drop("payload_bytes")


def network_mantissas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mantissas under a small network."""
    return _coded(spark, sf_dir, "network").drop("payload_bytes")


def context_mantissas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mantissas under counts of bits by the bits before them."""
    return _coded(spark, sf_dir, "contexts").drop("payload_bytes")


def mantissa_model_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all streams of a tensor under each model."""
    out = [_coded(spark, sf_dir, kind).select("tensor", F.lit(kind).alias("model"), "n_words", "payload_bytes") for kind in ("trees", "network", "contexts")]
    return out[0].unionByName(out[1]).unionByName(out[2])


def coupled_mantissas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of columns moved by coupling tables and back."""
    words = sample(spark, sf_dir)
    known = spark.sparkContext.broadcast(mantissa.couplings(words & 127) if len(words) else [])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            if len(batch):
                rows = _stacked(batch["ws"]) & 127
                back = mantissa.coupled(mantissa.coupled(rows, known.value), known.value, back=True)
                yield pd.DataFrame({"tensor": batch["tensor"], "n_words": rows.shape[1], "differing": (back != rows).sum(axis=1), "decoded_check": (back * (1 + np.arange(back.shape[1]))).sum(axis=1)})

    got = relations.rows(spark, sf_dir).select("tensor", "ws").mapInPandas(run, "tensor long, n_words long, differing long, decoded_check long")
    return got.groupBy("tensor").agg(*[F.sum(c).alias(c) for c in ("n_words", "differing", "decoded_check")])


#: Rows of a tensor that one stream of exponents holds; the longest run.
STREAM_ROWS, LONGEST_RUN = 16, 255
#: Forms in their fixed order, which decides ties.
FORMS = ("raw", "range", "huffman", "delta_range", "run_range")


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of runs of at most LONGEST_RUN."""
    if not len(values):
        return values, values
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    sizes = np.diff(np.append(starts, len(values)))
    parts = -(-sizes // LONGEST_RUN)
    lengths = np.full(int(parts.sum()), LONGEST_RUN)
    lengths[np.cumsum(parts) - 1] = sizes - (parts - 1) * LONGEST_RUN
    return np.repeat(values[starts], parts), lengths


def _table(counts: np.ndarray) -> bytes:
    seen = np.flatnonzero(counts)
    return len(seen).to_bytes(2, "little") + seen.astype("u1").tobytes() + counts[seen].astype("<u2").tobytes()


def _read_table(data: bytes) -> tuple[np.ndarray, int]:
    n = int.from_bytes(data[:2], "little")
    out = np.zeros(256, np.int64)
    out[np.frombuffer(data, np.uint8, n, 2)] = np.frombuffer(data, "<u2", n, 2 + n)
    return out, 2 + 3 * n


def _ranged(values: np.ndarray) -> bytes:
    freq = entropy.rans_frequencies(np.bincount(values, minlength=256))
    body = entropy.rans_encode(values[None], freq)[0]
    return _table(freq) + len(body).to_bytes(4, "little") + body


def _read_ranged(data: bytes, count: int) -> tuple[np.ndarray, int]:
    freq, at = _read_table(data)
    size = int.from_bytes(data[at : at + 4], "little")
    return entropy.rans_decode([data[at + 4 : at + 4 + size]], freq, count)[0], at + 4 + size


def encode_exponents(values: np.ndarray) -> bytes:
    """The cheapest form: its number, and what it needs. Runs compete where they are 1.5 long on average, tables from 64 on."""
    counts = np.bincount(values, minlength=256)
    forms = [(len(values), 0, values.astype("u1").tobytes())]
    if len(values) >= 64:
        lengths = entropy.huffman_lengths(counts)
        seen = np.flatnonzero(counts)
        book = len(seen).to_bytes(2, "little") + seen.astype("u1").tobytes() + lengths[seen].astype("u1").tobytes()
        coded = entropy.huffman_encode(values[None], lengths)[0] if lengths.any() else b""
        delta = (values - np.concatenate([[0], values[:-1]])) & 255
        forms += [(0, 1, _ranged(values)), (0, 2, book + coded), (0, 3, _ranged(delta))]
        value, length = runs(values)
        if len(values) >= 1.5 * len(value):
            forms.append((0, 4, len(value).to_bytes(4, "little") + _ranged(value) + _ranged(length)))
    best = min(forms, key=lambda f: (len(f[2]), f[1]))
    return bytes([best[1]]) + best[2]


def decode_exponents(data: bytes, count: int) -> np.ndarray:
    form, body = FORMS[data[0]], data[1:]
    if form == "raw":
        return np.frombuffer(body, np.uint8, count).astype(np.int64)
    if form == "huffman":
        n = int.from_bytes(body[:2], "little")
        lengths = np.zeros(256, np.int64)
        lengths[np.frombuffer(body, np.uint8, n, 2)] = np.frombuffer(body, np.uint8, n, 2 + n)
        if n == 1:
            return np.full(count, body[2], np.int64)
        return entropy.huffman_decode([body[2 + 2 * n :]], lengths, count)[0]
    if form == "run_range":
        n = int.from_bytes(body[:4], "little")
        value, at = _read_ranged(body[4:], n)
        length, _ = _read_ranged(body[4 + at :], n)
        return np.repeat(value, length)
    values, _ = _read_ranged(body, count)
    return np.cumsum(values) & 255 if form == "delta_range" else values


def exponent_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponents of stretches of rows in the cheapest of five forms: what comes back, and whether any costs over its raw
    bytes and one."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            out = []
            for tensor, rows in zip(batch["tensor"], batch["rows"], strict=True):
                values = np.concatenate([np.asarray(r["ws"], np.int64) for r in rows]) >> 7 & 255
                data = encode_exponents(values)
                back = decode_exponents(data, len(values))
                out.append((tensor, len(values), int((back != values).sum()), int((back * (1 + np.arange(len(back)))).sum()), int(len(data) > len(values) + 1), int(data[0] == 0)))
            yield pd.DataFrame(out, columns=["tensor", "n_words", "differing", "decoded_check", "dearer", "raw"])

    rows = relations.rows(spark, sf_dir).groupBy("tensor", F.expr(f"r div {STREAM_ROWS}").alias("part")).agg(F.array_sort(F.collect_list(F.struct("r", "ws"))).alias("rows"))  # STREAM_ROWS rows at most
    got = rows.select("tensor", "rows").mapInPandas(run, "tensor long, n_words long, differing long, decoded_check long, dearer long, raw long")
    return got.groupBy("tensor").agg(*[F.sum(c).alias(c) for c in ("n_words", "differing", "decoded_check", "dearer")])


QUERIES = {f.__name__: f for f in (tree_mantissas, network_mantissas, context_mantissas, mantissa_model_bits, coupled_mantissas, exponent_forms)}
_MANTISSAS = f"WITH {dialect.DUCK_RELATIONS['words']} SELECT tensor, CAST(count(*) AS BIGINT) AS n_words, CAST(0 AS BIGINT) AS differing, CAST(sum((w & 127) * (c + 1)) AS BIGINT) AS decoded_check FROM words GROUP BY tensor"
ORACLES = dict.fromkeys(("tree_mantissas", "network_mantissas", "context_mantissas", "coupled_mantissas"), _MANTISSAS) | {
    "exponent_forms": f"WITH {dialect.DUCK_RELATIONS['words']} SELECT tensor, CAST(count(*) AS BIGINT) AS n_words, CAST(0 AS BIGINT) AS differing, CAST(sum(((w >> 7) & 255) * (r % {STREAM_ROWS} * 64 + c + 1)) AS BIGINT) AS decoded_check, CAST(0 AS BIGINT) AS dearer FROM words GROUP BY tensor"
}
