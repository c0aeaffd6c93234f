"""Entropy coders over rows of symbols, in NumPy and in lockstep: all rows of a batch advance together.

Each row is a stream of its own under a table that its whole tensor shares, so streams decode in any order and no task
holds a tensor. Huffman codes are canonical by (length, symbol), at most 16 bits unless the best code is asked for, and
written low bit first; the range coder (rANS) has 12-bit frequencies, a 32-bit state above 2**23 and byte renormalisation.
"""

from __future__ import annotations

import heapq

import numpy as np

#: The longest code of a limited table, and the bits that are looked up at once.
LONGEST = 16
TOTAL, LOW = 4096, 1 << 23


def huffman_bits(counts: np.ndarray) -> int:
    """Bits of the best code of all that is counted: the sum of the tree's inner nodes."""
    heap = [int(n) for n in counts if n]
    heapq.heapify(heap)
    bits = 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heap[0]
        heapq.heapreplace(heap, both)
        bits += both
    return bits


def huffman_lengths(counts: np.ndarray, longest: int | None = LONGEST) -> np.ndarray:
    """Code lengths by symbol, 0 where the count is 0; the best code where `longest` is None. One symbol alone has length
    0: its stream is empty."""
    symbols = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    weights = counts[symbols].astype(np.int64)
    while len(symbols) > 1:
        heap = [(int(n), i, (int(s),)) for i, (n, s) in enumerate(zip(weights, symbols, strict=True))]
        heapq.heapify(heap)
        lengths[:] = 0
        made = len(heap)
        while len(heap) > 1:
            a, _, x = heapq.heappop(heap)
            b, _, y = heapq.heappop(heap)
            lengths[list(x + y)] += 1
            heapq.heappush(heap, (a + b, made, x + y))
            made += 1
        if longest is None or lengths.max() <= longest:
            break
        weights = np.maximum(weights // 2, 1)  # flatter counts until no code is too long
    return lengths


def huffman_codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes as rows of bits in the order of writing, 0 beyond a code's length."""
    codes = np.zeros((len(lengths), int(lengths.max(initial=0))), np.uint8)
    code = last = 0
    for symbol in np.lexsort((np.arange(len(lengths)), lengths)).tolist():
        n = int(lengths[symbol])
        if n:
            code <<= n - last
            codes[symbol, :n] = [int(b) for b in format(code, f"0{n}b")]
            code, last = code + 1, n
    return codes


def pack_bits(values: np.ndarray, widths: np.ndarray) -> bytes:
    """Values of the given widths one after another, low bit first."""
    ends = np.cumsum(widths)
    total = int(ends[-1]) if len(ends) else 0
    place = np.arange(total) - np.repeat(ends - widths, widths)
    bits = (np.repeat(values, widths) >> place) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def unpack_fixed(data: bytes, width: int, count: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: width * count].reshape(count, width)
    return bits.astype(np.int64) @ (1 << np.arange(width))


def huffman_encode(rows: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    codes, out = huffman_codes(lengths), []
    for row in rows:
        widths = lengths[row]
        starts = np.cumsum(widths) - widths
        place = np.arange(int(widths.sum())) - np.repeat(starts, widths)
        out.append(np.packbits(codes[np.repeat(row, widths), place], bitorder="little").tobytes())
    return out


def _lookup(lengths: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """How many bits to look up, the symbol of each such key and its width; for codes that are longer, ~node in place of
    the symbol, and the nodes beyond: by the next bit, a symbol or ~node."""
    codes, near = huffman_codes(lengths), min(int(lengths.max()), LONGEST)
    symbol, width, nodes = np.zeros(1 << near, np.int64), np.zeros(1 << near, np.int64), []
    for s in np.flatnonzero(lengths).tolist():
        n, key = int(lengths[s]), int(codes[s, :near] @ (1 << np.arange(near)))
        if n <= near:
            symbol[key :: 1 << n], width[key :: 1 << n] = s, n
            continue
        if not width[key]:
            symbol[key], width[key] = ~len(nodes), near
            nodes.append([0, 0])
        node, bits = ~int(symbol[key]), codes[s, near:n].tolist()
        for bit in bits[:-1]:
            if not nodes[node][bit]:
                nodes[node][bit] = ~len(nodes)
                nodes.append([0, 0])
            node = ~nodes[node][bit]
        nodes[node][bits[-1]] = s
    return near, symbol, width, np.array(nodes, np.int64).reshape(-1, 2)


def huffman_decode(streams: list[bytes], lengths: np.ndarray, count: int) -> np.ndarray:
    """streams to rows of `count` symbols."""
    if not lengths.any():
        raise ValueError("a code of one symbol needs the symbol")
    near, symbol, width, nodes = _lookup(lengths)
    size = max(map(len, streams), default=0) + 4
    data = np.zeros((len(streams), size), np.int64)
    for i, stream in enumerate(streams):
        data[i, : len(stream)] = np.frombuffer(stream, np.uint8)
    out, at, row = np.zeros((len(streams), count), np.int64), np.zeros(len(streams), np.int64), np.arange(len(streams))
    for k in range(count):
        byte = at >> 3
        window = data[row, byte] | data[row, byte + 1] << 8 | data[row, byte + 2] << 16
        key = (window >> (at & 7)) & ((1 << near) - 1)
        got = symbol[key]
        at += width[key]
        while len(nodes) and (deep := np.flatnonzero(got < 0)).size:
            bit = data[deep, at[deep] >> 3] >> (at[deep] & 7) & 1
            got[deep] = nodes[~got[deep], bit]
            at[deep] += 1
        out[:, k] = got
    return out


def rans_frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to sum to TOTAL, at least 1 each; what is left goes to the largest counts first."""
    out = np.zeros(len(counts), np.int64)
    seen = np.flatnonzero(counts)
    out[seen] = np.maximum(counts[seen] * TOTAL // counts.sum(), 1)
    order = seen[np.lexsort((seen, -counts[seen]))]
    left, i = TOTAL - int(out.sum()), 0
    while left:
        s = order[i % len(order)]
        step = 1 if left > 0 else -1
        if out[s] + step >= 1:
            out[s] += step
            left -= step
        i += 1
    return out


def rans_encode(rows: np.ndarray, freq: np.ndarray) -> list[bytes]:
    n, count = rows.shape
    start = np.cumsum(freq) - freq
    state = np.full(n, LOW, np.int64)
    out, used = np.zeros((n, 2 * count + 8), np.uint8), np.zeros(n, np.int64)
    for k in range(count - 1, -1, -1):
        f, s = freq[rows[:, k]], start[rows[:, k]]
        while (full := np.flatnonzero(state >= ((LOW >> 12) << 8) * f)).size:
            out[full, used[full]] = state[full] & 255
            used[full] += 1
            state[full] >>= 8
        state = (state // f << 12) + state % f + s
    return [int(x).to_bytes(4, "little") + out[i, : used[i]][::-1].tobytes() for i, x in enumerate(state)]


def rans_decode(streams: list[bytes], freq: np.ndarray, count: int) -> np.ndarray:
    n = len(streams)
    start = np.cumsum(freq) - freq
    slot = np.repeat(np.arange(len(freq)), freq)
    data = np.zeros((n, max(map(len, streams), default=0) + 4), np.int64)
    for i, stream in enumerate(streams):
        data[i, : len(stream)] = np.frombuffer(stream, np.uint8)
    state, at = data[:, :4] @ (1 << (8 * np.arange(4))), np.full(n, 4)
    out = np.zeros((n, count), np.int64)
    for k in range(count):
        low = state & (TOTAL - 1)
        s = slot[low]
        out[:, k] = s
        state = freq[s] * (state >> 12) + low - start[s]
        while (empty := np.flatnonzero(state < LOW)).size and (at[empty] < data.shape[1]).all():
            state[empty] = state[empty] << 8 | data[empty, at[empty]]
            at[empty] += 1
    if (state != LOW).any():
        raise ValueError("a stream does not end where it began")
    return out
