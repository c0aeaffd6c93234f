import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wordloom.functions import entropy
from wordloom.operators import codecs


def rows(n, count, symbols, seed):
    rng = np.random.default_rng(seed)
    return np.minimum(rng.geometric(0.2, (n, count)) - 1, symbols - 1)


@pytest.mark.parametrize("count", [1, 2, 17, 255, 256, 257])
@pytest.mark.parametrize("symbols", [2, 3, 40, 256])
def test_coders_round_trip(count, symbols):
    x = rows(5, count, symbols, count)
    counts = np.bincount(x.reshape(-1), minlength=256)
    for code in (codecs._huffman, codecs._rans, codecs._kbit, codecs._framed):
        payloads, back = code(x, counts)
        assert (back == x).all() and len(payloads) == 5


def test_one_symbol():
    x = np.full((3, 9), 7)
    for code in (codecs._huffman, codecs._rans, codecs._kbit):
        assert (code(x, np.bincount(x.reshape(-1), minlength=256))[1] == x).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), min_size=1, max_size=256))
def test_lengths_make_a_prefix_code(counts):
    lengths = entropy.huffman_lengths(np.array(counts))
    used = lengths[lengths > 0]
    assert lengths.max() <= entropy.LONGEST
    assert (2.0 ** -used).sum() <= 1
    freq = entropy.rans_frequencies(np.array(counts)) if any(counts) else None
    assert freq is None or freq.sum() == entropy.TOTAL and (freq[np.array(counts) > 0] > 0).all()


def fibonacci(n):
    """Counts of n symbols with codes of up to n - 1 bits."""
    out = [1, 1]
    while len(out) < n:
        out.append(out[-1] + out[-2])
    return np.array(out[:n])


@pytest.mark.parametrize("n", [2, 17, 18, 19, 40, 66, 85])
def test_the_best_code_of_any_length_comes_back(n):
    rng = np.random.default_rng(n)
    symbols = rng.permutation(256)[:n]
    counts = np.zeros(256, np.int64)
    counts[symbols] = fibonacci(n)
    lengths = entropy.huffman_lengths(counts, None)
    assert lengths.max() == n - 1
    assert entropy.huffman_bits(counts) == sum(int(a) * int(b) for a, b in zip(counts, lengths, strict=True))
    x = rng.choice(symbols, (7, 90))
    payloads, back = codecs._huffman(x, counts)
    assert (back == x).all()
    assert [len(p) for p in payloads] == [-(-int(lengths[row].sum()) // 8) for row in x]
    assert (codecs._huffman_bits(x, counts) == lengths[x].sum(axis=1)).all()


def test_huffman_is_no_worse_than_the_entropy_by_a_bit():
    x = rows(50, 400, 60, 1)
    counts = np.bincount(x.reshape(-1), minlength=256)
    p = counts[counts > 0] / counts.sum()
    bits = (counts * entropy.huffman_lengths(counts)).sum() / counts.sum()
    assert -(p * np.log2(p)).sum() <= bits < -(p * np.log2(p)).sum() + 1


@pytest.mark.parametrize("change", [lambda b: b"XXXX" + b[4:], lambda b: b[:-1], lambda b: b + b"0", lambda b: b[:-1] + bytes([b[-1] ^ 1])])
def test_corrupt_frames_are_refused(change):
    [frame], _ = codecs._framed(np.arange(40)[None, :], np.ones(256, np.int64))
    with pytest.raises(ValueError):
        codecs.read_frame(change(frame))
