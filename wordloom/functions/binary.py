"""A range coder of bits with a probability for each, in lockstep over rows, and fixed-width codes high bit first."""

from __future__ import annotations

import numpy as np

from wordloom.functions.entropy import LOW, TOTAL


def frequencies(p: np.ndarray) -> np.ndarray:
    """Probabilities of a one as frequencies out of TOTAL, never none or all."""
    return np.clip(np.rint(np.asarray(p, np.float64) * TOTAL).astype(np.int64), 1, TOTAL - 1)


def encode(bits: np.ndarray, ones: np.ndarray) -> list[bytes]:
    """bits and frequencies of a one (rows x count) to a stream for each row."""
    rows, count = bits.shape
    state = np.full(rows, LOW, np.int64)
    out, used = np.zeros((rows, 2 * count + 8), np.uint8), np.zeros(rows, np.int64)
    for k in range(count - 1, -1, -1):
        one = bits[:, k] == 1
        f, start = np.where(one, ones[:, k], TOTAL - ones[:, k]), np.where(one, TOTAL - ones[:, k], 0)
        while (full := np.flatnonzero(state >= ((LOW >> 12) << 8) * f)).size:
            out[full, used[full]] = state[full] & 255
            used[full] += 1
            state[full] >>= 8
        state = (state // f << 12) + state % f + start
    return [int(x).to_bytes(4, "little") + out[i, : used[i]][::-1].tobytes() for i, x in enumerate(state)]


class Decoder:
    """Bits of all rows, one place at a time; the frequencies of the next place may depend on what came before."""

    def __init__(self, streams: list[bytes]):
        self.data = np.zeros((len(streams), max(map(len, streams), default=0) + 4), np.int64)
        for i, stream in enumerate(streams):
            self.data[i, : len(stream)] = np.frombuffer(stream, np.uint8)
        self.state, self.at = self.data[:, :4] @ (1 << (8 * np.arange(4))), np.full(len(streams), 4)

    def next(self, ones: np.ndarray) -> np.ndarray:
        low = self.state & (TOTAL - 1)
        bit = low >= TOTAL - ones
        f, start = np.where(bit, ones, TOTAL - ones), np.where(bit, TOTAL - ones, 0)
        self.state = f * (self.state >> 12) + low - start
        while (empty := np.flatnonzero(self.state < LOW)).size and (self.at[empty] < self.data.shape[1]).all():
            self.state[empty] = self.state[empty] << 8 | self.data[empty, self.at[empty]]
            self.at[empty] += 1
        return bit.astype(np.int64)

    def close(self) -> None:
        if (self.state != LOW).any():
            raise ValueError("a stream does not end where it began")


def decode(streams: list[bytes], ones: np.ndarray) -> np.ndarray:
    reader = Decoder(streams)
    out = np.stack([reader.next(ones[:, k]) for k in range(ones.shape[1])], axis=1) if ones.shape[1] else np.zeros(ones.shape, np.int64)
    reader.close()
    return out


def pack_high(values: np.ndarray, width: int) -> bytes:
    """Values of `width` bits one after another, high bit first."""
    bits = (np.asarray(values, np.int64)[:, None] >> np.arange(width - 1, -1, -1)) & 1
    return np.packbits(bits.astype(np.uint8).reshape(-1)).tobytes()


def unpack_high(data: bytes, width: int, count: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8))[: width * count].reshape(count, width)
    return bits.astype(np.int64) @ (1 << np.arange(width - 1, -1, -1))
