import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Library

from wordloom.llm import packing, pieces, token_files
from wordloom.llm.tokens import Tokenizer, crc32_of


@pytest.fixture(scope="module")
def both(bpe):
    library = Library.from_file(bpe)
    library.encode_special_tokens = True
    return Tokenizer(bpe, entries=2000), library


ALPHABET = "ab \n\t é'1.\r\x1c　᠎|日😀"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=20), max_size=5))
def test_memo_equals_the_library(both, texts):
    own, library = both
    ids, at = own.encode(texts)
    assert [ids[p:q].tolist() for p, q in zip(at[:-1], at[1:], strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_documents_equal_the_library(both, texts):
    own, library = both
    sample = list(texts.values())
    ids, at = own.encode(sample)
    assert [ids[p:q].tolist() for p, q in zip(at[:-1], at[1:], strict=True)] == [e.ids for e in library.encode_batch(sample, add_special_tokens=False)]


class Counting:
    """A library that keeps the texts it is given."""

    def __init__(self, library):
        self.library, self.sent = library, []

    def encode_batch_fast(self, texts, **how):
        self.sent += texts
        return self.library.encode_batch_fast(texts, **how)

    def encode_batch(self, texts, **how):
        self.sent += texts
        return self.library.encode_batch(texts, **how)


def test_known_words_do_not_reach_the_library_again(bpe):
    own = Tokenizer(bpe)
    own.encode(["x alpha beta. gamma, don't\nline слово"])
    own.merges, own.library = Counting(own.merges), Counting(own.library)
    ids, _ = own.encode(["x beta, alpha. gamma,\nline. beta don't слово alpha,"])
    assert len(ids) and not own.merges.sent and not own.library.sent


PARTS = [" ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "'s", "don't", "the", "The", "ing", ",", "...", "&&&", "0", "2024", "é", "ª", "²", "×", "ɏ", "ɐ", "ǅ", "слово", "日本", "😀", "\x00", "\x1c", "\x85", "\xa0", "ÿ", "a" * 30, "<|endoftext|>"]


@pytest.mark.parametrize("entries", [1, 64, 1 << 12])
def test_a_memo_that_forgets_equals_the_library(bpe, both, entries):
    own, rng = Tokenizer(bpe, entries=entries), random.Random(entries)
    for _ in range(40):
        texts = ["".join(rng.choice(PARTS) for _ in range(rng.choice([1, 4, 40]))) for _ in range(40)]
        ids, at = own.encode(texts)
        assert [ids[p:q].tolist() for p, q in zip(at[:-1], at[1:], strict=True)] == [e.ids for e in both[1].encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 10**9), min_size=2, max_size=200), st.integers(8, 16))
def test_lengths_are_limited_and_no_worse_than_flat(counts, longest):
    lengths = token_files.code_lengths(np.array(counts), longest)
    assert lengths.max() <= longest and (2.0**-lengths).sum() == 1
    assert (lengths * counts).sum() <= sum(counts) * max(1, (len(counts) - 1).bit_length())


@pytest.mark.parametrize("sizes", [[1], [0, 3, 0], [600, 1, 513], [1] * 40])
def test_blocks_round_trip(sizes):
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.geometric(0.05, sum(sizes)), 300)
    known, counts = np.unique(ids, return_counts=True)
    code = token_files.Code(known, token_files.code_lengths(counts, 16))
    block = token_files.write_block(code, [None, *range(1, len(sizes))], sizes, ids, 77)
    before, index, back, at = token_files.read_block(block)
    assert before == 77 and (back == ids).all() and index["f2"].tolist() == sizes and np.diff(at).tolist() == sizes
    with pytest.raises(ValueError):
        token_files.read_block(b"XXXX" + block[4:])
    with pytest.raises(ValueError):
        token_files.read_block(block[:-1])


def wanted(library, rows, end):
    return [library.encode(t or "", add_special_tokens=False).ids + [end] for _, t in rows]


def test_files_hold_all_documents(spark, documents, odd, both, bpe):
    for df, files in ((documents, 3), (odd, None)):
        rows = sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
        got = sorted(token_files.read_documents(token_files.token_files(df, bpe, 2, files=files)).collect(), key=lambda r: r.start)
        ids = wanted(both[1], rows, 2)
        assert [r.doc_id for r in got] == [r[0] for r in rows]
        assert sorted(map(tuple, (r.ids for r in got))) == sorted(map(tuple, ids))
        assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.n_tokens == len(r.ids) for r in got)


def test_files_of_nothing(nothing, bpe):
    assert token_files.query(nothing.sparkSession, nothing, bpe).count() == 0


def test_packing(spark, documents, odd, both, bpe):
    for df, capacity in ((documents, 2048), (odd, 64)):
        rows = packing.pack_documents(df, bpe, capacity=capacity).collect()
        total = {}
        by = {}
        for r in rows:
            assert r.length == len(r.ids) <= capacity and r.ids_crc32 == crc32_of(np.array(r.ids))
            by.setdefault(r.sequence_id, []).append(r)
            total.setdefault(r.doc_id, []).append(r)
        for own in by.values():
            own.sort(key=lambda r: r.offset)
            assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
            assert sum(r.length for r in own) <= capacity
        for doc_id, text in {(r.doc_id, r.text) for r in df.collect()}:
            ids = both[1].encode(text or "", add_special_tokens=False).ids + [0]
            parts = sorted(total[doc_id], key=lambda r: (r.piece, r.sequence_id))
            copies = len(parts) // (max(r.piece for r in parts) + 1)
            assert sum((r.ids for r in parts[::copies]), []) == ids
            assert all(r.length == capacity for r in parts if r.piece)
        used = sum(r.length for r in rows)
        assert len(by) <= 1.02 * used / capacity + 2


def test_packing_of_nothing(nothing, bpe):
    assert packing.query(nothing.sparkSession, nothing, bpe).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), min_size=1))
def test_plan_uses_every_length_once(histogram):
    bins = packing.plan(list(histogram), list(histogram.values()), 50)
    got = {}
    for times, chosen in bins:
        assert times > 0 and sum(s * n for s, n in chosen.items()) <= 50
        for s, n in chosen.items():
            got[s] = got.get(s, 0) + n * times
    assert got == histogram
    table = packing.places(bins)
    for size in histogram:
        own = sorted(map(tuple, table[table[:, 0] == size]), key=lambda t: t[1])
        assert [t[1] for t in own] == np.cumsum([0] + [t[2] for t in own])[:-1].tolist()


def test_two_fit_beats_greedy():
    # greedy puts 6 + 3 in a bin of 10; two that fit the gap of the 3 and 1 more tightly are 2 + 2
    bins = packing.plan([6, 3, 2], [1, 1, 2], 10)
    assert bins[0] == (1, {6: 1, 2: 2})


# SentencePiece


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The public vocabulary as a unigram model; scores that float32 can add."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    sentencepiece = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for piece in model.pieces:
        piece.score = max(piece.score, -50000)
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(model.SerializeToString())
    return str(path), sentencepiece.SentencePieceProcessor(model_file=str(path))


def test_viterbi_equals_the_library(unigram, texts):
    path, library = unigram
    own = pieces.Encoder(path)
    lines = [line for t in list(texts.values())[:60] for line in t.split("\n")]
    rng = random.Random(1)
    lines += ["", " ", "a  b", "\n\na", "▁a"] + ["".join(rng.choice(ALPHABET + "▁the ") for _ in range(rng.randint(0, 14))) for _ in range(2000)]
    got = own.encode(lines)
    assert [g.tolist() for g in got] == [library.encode(x) for x in lines]
    assert [own.decode(g.astype(np.int64)) for g in got] == [x.replace("▁", " ") for x in lines]


def brute(v, word):
    """Best sum over all segmentations."""
    best = {0: 0.0}
    for end in range(1, len(word) + 1):
        best[end] = max(best[s] + v.score.get(word[s:end], v.unknown if end - s == 1 else float("-inf")) for s in range(end))
    return best[len(word)]


def test_scores_are_the_best(texts):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    v = pieces.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    words = sorted({"▁" + w for t in list(texts.values())[:20] for w in t.split()})[:1500]
    pieces_of = {i: p for p, i in v.id.items()}
    for word, ids in v.segment(words):
        known = [pieces_of[i] for i in ids if i in pieces_of]
        if "".join(known) == word:
            assert sum(v.score[p] for p in known) == brute(v, word)


def test_round_trip_query(spark, documents, odd, nothing):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("piece_bpe_32k.model")
    for df in (documents, odd, nothing):
        got = pieces.query(spark, df, path).collect()
        assert len(got) == df.count() and all(r.round_trip for r in got)
        assert all((r.n_tokens == 0) == (not t) for r, t in zip(sorted(got, key=lambda r: r.doc_id or 0), [x.text for x in sorted(df.collect(), key=lambda r: r.doc_id or 0)], strict=True))
