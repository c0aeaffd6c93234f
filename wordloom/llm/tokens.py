"""Whole-text tokenising with the tokenizers library, each distinct stretch of text only once.

The byte-level pre-tokeniser never joins a white-space character that precedes a visible one to what stands before
it, so a text may be cut before any such character and its parts encoded alone. Parts repeat (they are words): Arrow
cuts the texts of a batch into units and finds the distinct ones; these are cut into pieces (words, numbers, marks),
whose ids are kept in a bounded memo, a table of arrays, and only new pieces reach the library, many in one call.
Equality with encoding the whole text in one call is tested.
"""

from __future__ import annotations

import codecs
import os
import re
import string
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from wordloom.llm.common import places as _places
from wordloom.llm.common import stretches

#: The letters that a byte-level vocabulary writes for bytes (a fixed rule of byte-level BPE): visible Latin-1 characters
#: stand for themselves, the other bytes for U+0100 and on.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LETTERS = {b: 0x100 + i for i, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}
LETTERS = "".join(chr(BYTE_LETTERS.get(b, b)) for b in range(256))
#: Bytes that no UTF-8 text has: the letter of one parts the pieces that are encoded in one call.
NEVER = (0xFF, 0xFE, 0xC0, 0xC1, *range(0xF5, 0xFE))
#: Pieces in one text of such a call.
TOGETHER = 128
#: Below this character, letters and numbers are the same in all versions of Unicode.
LATIN_END = 0x250
LATIN_LETTERS = np.array([regex.match(r"\p{L}", chr(c)) is not None for c in range(LATIN_END)])
#: Kinds of bytes. The pre-tokeniser cuts where the kind changes, but joins a space to what follows; a unit with any
#: OTHER byte is left to the whole library.
OTHER, LETTER, DIGIT, MARK, SPACE, LINE = range(6)
KINDS = np.full(256, OTHER, np.uint8)
for _kind, _own in ((LETTER, string.ascii_letters), (DIGIT, string.digits), (MARK, string.punctuation.replace("'", "")), (SPACE, " "), (LINE, "\n")):
    KINDS[list(_own.encode())] = _kind
UNITS = re.compile(r"\s*\S+|\s+")
#: White space that a text may end in.
SPACES = " \t\n\x0b\x0c\r"
#: A memo key: the bytes of a piece, zeros, and in the last byte its length.
LANES = 3
#: Stretches of ids that are put together at a time.
GATHERED = 1 << 16
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _gathered(flat: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """flat[at : at + n] of all pairs, one after another; some at a time, so that the places take little memory."""
    out, done = np.empty(int(n.sum()), flat.dtype), 0
    for i in range(0, len(at), GATHERED):
        own = n[i : i + GATHERED]
        reach = np.cumsum(own)
        place = np.repeat(at[i : i + GATHERED] - (reach - own), own)
        place += np.arange(len(place))
        out[done : done + len(place)] = flat[place]
        done += len(place)
    return out


def _bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array one after another, and where each value begins and the last ends."""
    at, size = _places(values)
    if not len(values) or not size.any():
        return np.zeros(0, np.uint8), np.zeros(len(values) + 1, np.int64)
    ends = np.append(at, at[-1] + size[-1])
    return np.frombuffer(values.buffers()[2], np.uint8, int(ends[-1] - ends[0]), int(ends[0])), ends - ends[0]


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), pa.py_buffer(data)])


def _kinds(data: np.ndarray) -> np.ndarray:
    kinds = KINDS[data]
    lead = np.flatnonzero((data >= 0xC2) & (data < 0xC0 | LATIN_END >> 6))
    lead = lead[LATIN_LETTERS[(data[lead].astype(np.int64) & 0x1F) << 6 | data[lead + 1] & 0x3F]]
    kinds[lead] = kinds[lead + 1] = LETTER
    return kinds


def _cut(units: pa.LargeStringArray) -> tuple[pa.LargeBinaryArray, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cut units into pieces. A unit that begins with a space stands for the raw text after it, one that begins with a
    line end for itself, any other for a space and itself. Returns the distinct pieces; how many of them, the first
    ones, are of one kind (the others are raw texts that the whole library has to cut); which of them the units have, one
    after another; for each unit where its pieces begin there and their number; and which units have no safe cut."""
    joined = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), units, pa.scalar("", pa.large_string()))
    data, ends = _bytes(joined)
    kinds, size = _kinds(data), np.diff(ends)
    begins, of_two = ends[:-1], size > 1
    first = np.full(len(units), OTHER, np.uint8)
    first[of_two] = kinds[begins[of_two] + 1]
    raw = (first == SPACE) | (first == LINE)
    strange = (kinds == OTHER) | (kinds == SPACE) | (kinds == LINE)
    strange[begins] = False
    strange[begins[raw & (size > 2)] + 1] = False
    slow = ~of_two
    slow[np.searchsorted(begins, np.flatnonzero(strange), "right") - 1] = True
    texts, bad, late = [], np.zeros(len(units), bool), np.flatnonzero(slow)
    for i, unit in zip(late.tolist(), units.take(pa.array(late)).to_pylist(), strict=True):
        bad[i] = not unit or (unit[0] != " " and unit[0].isspace() and (unit[0] != "\n" or len(unit) == 1 or unit[1].isspace()))
        if not bad[i]:
            texts.append((unit[1:] if unit[0] == " " else unit if unit[0] == "\n" else " " + unit).encode())
    if len(late):
        plain = np.repeat(~slow, size)
        data, kinds, size = data[plain], kinds[plain], size[~slow]
        begins = np.cumsum(size) - size
    own = raw[~slow]
    change = np.ones(len(kinds), bool)
    change[1:] = kinds[1:] != kinds[:-1]
    change[begins] = True
    change[begins[~own] + 1] = False
    cuts = np.flatnonzero(change)
    heads = np.searchsorted(cuts, begins)
    taken = np.ones(len(cuts), bool)
    taken[heads[own]] = False  # the space put before a raw text is none of it
    pieces = _binary(data, np.append(cuts, len(data)))
    found = pa.concat_arrays([pieces, pa.array(texts, pa.large_binary())]).dictionary_encode()
    index = found.indices.to_numpy()
    n = np.zeros(len(units), np.int64)
    n[~slow], n[slow & ~bad] = np.diff(heads, append=len(cuts)) - own, 1
    at = np.zeros(len(units), np.int64)
    at[~slow] = np.cumsum(n[~slow]) - n[~slow]
    at[slow & ~bad] = int(taken.sum()) + np.arange(len(texts))
    simple = int(index[: len(cuts)].max(initial=-1)) + 1
    return found.dictionary, simple, np.concatenate([index[: len(cuts)][taken], index[len(cuts) :]]), at, n, bad


class Tokenizer:
    """The memo is a table that grows with what it holds up to `entries` places (a power of two at least), each with the key
    of a piece and where its ids are in `flat`. A piece has two places that it may take; the last comer stays. Pieces of over 8 * LANES - 1 bytes are
    not kept."""

    def __init__(self, path: str, entries: int = 1 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        self.library.encode_special_tokens = True
        self.vocabulary = self.library.get_vocab_size()
        # the same merge model, for pieces that are cut and spelled in byte letters already
        self.merges = Library(self.library.model)
        self.letters = np.zeros(self.vocabulary, np.int64)
        alone = {LETTERS[b]: [] for b in NEVER}
        for token, i in self.library.get_vocab().items():
            self.letters[i] = len(token)
            for letter in alone.keys() & set(token):
                alone[letter].append((token, i))
        # a letter that no other token has is in no merge, so that nothing is merged across it
        free = [(letter, own[0][1]) for letter, own in alone.items() if [t for t, _ in own] == [letter]]
        if not free:
            raise ValueError("every byte letter of this vocabulary is in some longer token")
        self.letter, self.between = free[0]
        self.byte = bytes([LETTERS.index(self.letter)])
        self.most = max(1, (entries - 1).bit_length())
        self.clear()

    def clear(self) -> None:
        self._sized(min(self.most, 10))
        self.used, self.flat = 0, np.zeros(1 << 14, np.uint32)

    def _sized(self, bits: int) -> None:
        self.bits, self.held = bits, 0
        self.keys = np.zeros((1 << bits, LANES), np.uint64)
        self.at, self.n = np.zeros(1 << bits, np.uint32), np.zeros(1 << bits, np.uint8)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        mixed = np.bitwise_xor.reduce(keys * _MIX, axis=1)
        return ((mixed ^ mixed >> np.uint64(32)) * _MIX[0] >> np.uint64(64 - self.bits)).astype(np.int64)

    def _put(self, keys: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        bits = min(self.most, int(2 * (self.held + len(keys))).bit_length())
        if bits > self.bits:
            full = np.flatnonzero(self.keys.any(axis=1))
            old = self.keys[full], self.at[full], self.n[full]
            self._sized(bits)
            self._put(*old)
        own = self._place(keys)
        own = np.where(self.keys[own].any(axis=1) & ~self.keys[own ^ 1].any(axis=1), own ^ 1, own)
        self.keys[own] = keys
        stays = (self.keys[own] == keys).all(axis=1)
        self.at[own[stays]], self.n[own[stays]] = at[stays], n[stays]
        self.held += len(keys)

    def _keep(self, ids: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _merged(self, pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of one kind and their numbers."""
        if not len(pieces):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        groups = pa.LargeListArray.from_arrays(pa.array(np.append(np.arange(0, len(pieces), TOGETHER), len(pieces)), pa.int64()), pieces)
        spelled = [codecs.charmap_decode(x, "strict", LETTERS)[0] + self.letter for x in pc.binary_join(groups, pa.scalar(self.byte, pa.large_binary())).to_pylist()]
        found = [e.ids for e in self.merges.encode_batch_fast(spelled, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(found), np.uint32, sum(map(len, found)))
        parting = ids == self.between
        sizes, ids = np.diff(np.flatnonzero(parting), prepend=-1) - 1, ids[~parting]
        if len(sizes) != len(pieces) or self.letters[ids].sum() != _places(pieces)[1].sum():
            raise ValueError("this vocabulary does not spell every byte")
        return ids, sizes

    def _learned(self, pieces: pa.LargeBinaryArray, simple: int) -> tuple[np.ndarray, np.ndarray]:
        """Where in `flat` the ids of new pieces, of which the first `simple` are of one kind, begin, and their numbers."""
        ids, sizes = self._merged(pieces[:simple])
        if simple < len(pieces):
            found = [e.ids for e in self.library.encode_batch_fast([x.decode() for x in pieces[simple:].to_pylist()], add_special_tokens=False)]
            ids = np.concatenate([ids, np.fromiter(chain.from_iterable(found), np.uint32)])
            sizes = np.concatenate([sizes, np.fromiter(map(len, found), np.int64, len(found))])
        at = self.used + np.cumsum(sizes) - sizes
        self._keep(ids)
        return at, sizes

    def _found(self, pieces: pa.LargeBinaryArray, simple: int) -> tuple[np.ndarray, np.ndarray]:
        """Where in `flat` the ids of distinct pieces begin, and their numbers."""
        data, ends = _bytes(pieces)
        begins, size = ends[:-1], np.diff(ends)
        data = np.concatenate([data, np.zeros(8 * LANES + 8, np.uint8)])
        eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        keys = np.stack([eights[begins + 8 * i] & _MASKS[np.clip(size - 8 * i, 0, 8)] for i in range(LANES)], axis=1)
        kept = size < 8 * LANES
        keys[:, -1] |= np.where(kept, size, 0).astype(np.uint64) << np.uint64(56)
        place = self._place(keys)
        at, n, missing = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64), np.arange(len(pieces))
        for other in (0, 1):
            own = place[missing] ^ other
            hit = kept[missing] & (self.keys[own] == keys[missing]).all(axis=1)
            at[missing[hit]], n[missing[hit]] = self.at[own[hit]], self.n[own[hit]]
            missing = missing[~hit]
        if len(missing):
            at[missing], n[missing] = self._learned(pieces.take(pa.array(missing)), int(np.searchsorted(missing, simple)))
            new = missing[kept[missing] & (n[missing] < 256)]
            self._put(keys[new], at[new], n[new])
        return at, n

    def _units(self, units: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the units one after another in some order, where those of each begin, their number, and which units have
        no safe cut."""
        pieces, simple, index, first, number, bad = _cut(units)
        at, n = self._found(pieces, simple)
        sizes = n[index]
        reach = np.concatenate([[0], np.cumsum(sizes)])
        return _gathered(self.flat, at[index], sizes), reach[first], reach[first + number] - reach[first], bad

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (uint32), and where each text begins and the last ends."""
        rows = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string())
        got = [self._encode(rows[i:j]) for i, j in stretches(rows)]
        if len(got) == 1:
            return got[0]
        sizes = np.concatenate([np.zeros(1, np.int64), *[np.diff(ends) for _, ends in got]])
        return np.concatenate([np.zeros(0, np.uint32), *[ids for ids, _ in got]]), np.cumsum(sizes)

    def _encode(self, rows: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        if self.used > 4 << self.most:
            self.clear()
        # Arrow cuts the texts and finds the distinct units; they are cut and looked up once for all these texts
        body = pc.utf8_rtrim(rows, characters=SPACES)
        parts = pc.split_pattern(pc.replace_substring(body, pattern="\n", replacement=" \n"), pattern=" ")
        ends = parts.offsets.to_numpy().astype(np.int64)
        ends -= ends[0]
        flat = parts.flatten()
        units = flat.dictionary_encode()
        index = units.indices.to_numpy().astype(np.int64)
        known = len(units.dictionary)
        index[ends[:-1]] = known + np.arange(len(rows))
        firsts = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), flat.take(pa.array(ends[:-1])), pa.scalar(" ", pa.large_string()))
        units = units.dictionary
        del parts, flat
        lost = np.zeros(len(rows), bool)
        at, size = _places(rows)
        tails, own = np.flatnonzero(size > (keep := pc.binary_length(body).to_numpy())), []
        if len(tails):
            data = rows.buffers()[2]
            own = [" " + data[int(at[i] + keep[i]) : int(at[i] + size[i])].to_pybytes().decode() for i in tails]
            lost[tails] = [x.isspace() for x in pc.utf8_slice_codeunits(body.take(pa.array(tails)), -1).to_pylist()]
            index = np.insert(index, ends[1:][tails], known + len(rows) + np.arange(len(tails)))
            ends = ends + np.concatenate([[0], np.cumsum(size > keep)])
        ids, begins, n, bad = self._units(pa.concat_arrays([units, firsts, pa.array(own, pa.large_string())]))
        wrong = np.flatnonzero(bad[index]) if bad.any() else []
        lost[np.searchsorted(ends, wrong, "right") - 1] = True
        if lost.any():
            pieces, last, sizes, strange = [], 0, np.diff(ends), []
            for i in np.flatnonzero(lost):
                own = [" " + u for u in UNITS.findall(rows[int(i)].as_py())]
                pieces += [index[ends[last] : ends[i]], len(n) + len(strange) + np.arange(len(own))]
                strange += own
                sizes[i], last = len(own), i + 1
            index = np.concatenate([*pieces, index[ends[last] :]])
            ends = np.concatenate([[0], np.cumsum(sizes)])
            more = pa.array(strange, pa.large_string()).dictionary_encode()
            own_ids, own_begins, own_n, _ = self._units(more.dictionary)
            of = more.indices.to_numpy()
            begins, n = np.concatenate([begins, len(ids) + own_begins[of]]), np.concatenate([n, own_n[of]])
            ids = np.concatenate([ids, own_ids])
        n = n[index]
        return _gathered(ids, begins[index], n), np.concatenate([[0], np.cumsum(n)])[ends]


_TOKENIZERS: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """One for each Python worker."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Tokenizer(path)
    return _TOKENIZERS[path]


def crc32_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
