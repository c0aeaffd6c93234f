"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text becomes marked words: the library's space mark stands before each, and pieces cross neither from a word into a
mark nor over a line end (checked when the vocabulary is read), so that words can be segmented alone. The distinct
words of a batch are sorted, which is the depth-first order of their trie; a stack holds the forward scores, best
starts and pieces of the word before, and a word keeps those of the prefix that it shares with it. So each node of
the trie is scored once. Segmentations of words stay in a bounded memo.

The result is the best segmentation under the sum of piece scores, as a unigram model over the vocabulary defines it:
the largest sum; of equal sums the longest last piece. An unknown character costs ten more than the lowest score and
becomes its bytes. (A vocabulary that was trained by merges is used with its own scores, as a unigram vocabulary; that
is not the order of merges. Tests hold the ids against the library with the model type set to unigram.)

Cases: null text counts as empty; an empty text has no ids; the mark character itself reads back as a space, as in
the library; rows that repeat an id each get a row; an empty table gives no rows; any id, null too, passes through.
Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import prepare, stretches, whole_text

MARK = "▁"
#: Bytes of text that are segmented at a time.
STRETCH = 4 << 20
UNITS = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*")


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte = [0] * 256
        self.surface: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:-1], 16)] = i
                self.surface.append(bytes([int(piece[3:-1], 16)]))
            elif model.is_control(i):
                self.surface.append(b"")
            elif model.is_unknown(i):
                self.surface.append(" ⁇ ".encode())
            else:
                self.surface.append(piece.replace(MARK, " ").encode())
                if not model.is_unused(i):
                    self.id[piece], self.score[piece] = i, model.get_score(i)
        if any("\n" in p or MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("pieces of this vocabulary cross words")
        #: Lengths of the pieces of two characters or more, longest first, by their last two characters.
        self.lengths: dict[str, list[int]] = {}
        for piece in sorted(self.id, key=len, reverse=True):
            if len(piece) > 1 and len(piece) not in self.lengths.setdefault(piece[-2:], []):
                self.lengths[piece[-2:]].append(len(piece))
        self.unknown = min(self.score.values()) - 10
        self.sizes = np.array([len(s) for s in self.surface])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.letters = np.frombuffer(b"".join(self.surface), np.uint8)

    def segment(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """Distinct words in any order to (word, ids), in sorted order."""
        score, ids, byte, lengths, unknown = self.score, self.id, self.byte, self.lengths, self.unknown
        best, start, last = [0.0], [0], ""
        for word in sorted(words):
            shared = len(commonprefix((last, word)))
            del best[shared + 1 :], start[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                top, at = float("-inf"), end - 1
                if end > 1:
                    for n in lengths.get(word[end - 2 : end], ()):
                        own = score.get(word[end - n : end]) if n <= end else None
                        if own is not None and best[end - n] + own > top:
                            top, at = best[end - n] + own, end - n
                own = best[end - 1] + score.get(word[end - 1], unknown)
                if own > top:
                    top, at = own, end - 1
                best.append(top)
                start.append(at)
            out, end = [], len(word)
            while end:
                s = start[end]
                piece = ids.get(word[s:end])
                if piece is None:
                    out.extend(byte[b] for b in reversed(word[s:end].encode()))
                else:
                    out.append(piece)
                end = s
            last = word
            yield word, out[::-1]


class Encoder:
    """Texts to ids, with a memo of words. Keys: a word without its mark, or a line end and what follows it."""

    def __init__(self, path: str, entries: int = 1 << 19, longest: int = 48):
        self.vocabulary, self.entries, self.longest = Vocabulary(path), entries, longest
        self.memo: dict[str, bytes] = {}

    @staticmethod
    def keys(text: str) -> list[str]:
        if not text:
            return []
        parts = text.replace("\n", " \n").split(" ")
        if "" in parts or MARK in text:
            units = UNITS.findall(MARK + text.replace(" ", MARK))
            return [u[1:] if u[0] == MARK else u for u in units]
        return parts

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.memo) > self.entries:
            self.memo.clear()
        keys = [self.keys(t) for t in texts]
        new = {k for own in keys for k in own if k not in self.memo}
        words = {("\n" if k[:1] == "\n" else MARK) + (k[1:] if k[:1] == "\n" else k): k for k in new}
        memo = self.memo
        for word, ids in self.vocabulary.segment(list(words)):
            memo[words[word]] = np.array(ids, "<u4").tobytes()
        out = [np.frombuffer(b"".join(map(memo.__getitem__, own)), "<u4") for own in keys]
        for k in new:
            if len(k) > self.longest:
                del memo[k]
        return out

    def decode(self, ids: np.ndarray) -> str:
        v = self.vocabulary
        n = v.sizes[ids]
        reach = np.cumsum(n)
        total = int(reach[-1]) if len(reach) else 0
        text = v.letters[np.repeat(v.starts[ids] - (reach - n), n) + np.arange(total)].tobytes().decode(errors="replace")
        return text[1:] if text[:1] == " " else text


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, ids (array of int)."""
    prepare(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for b in it:
            for i, j in stretches(b.column(1), STRETCH):
                ids = own.encode(b.column(1)[i:j].to_pylist())
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int32)
                yield pa.record_batch([b.column(0)[i:j].cast(pa.int64()), b.column(1)[i:j], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "text", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text")).mapInArrow(run, "doc_id long, text string, ids array<int>")


def decoded(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """rows with `decoded`, the text of their ids."""

    @F.pandas_udf("string")
    def text_of(values):
        import pandas as pd

        own = encoder(path)
        return pd.Series([own.decode(np.asarray(v, np.int64)) for v in values])

    return rows.withColumn("decoded", text_of(ids))


def query(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), decoded_crc32 (of the
    decoded text in UTF-8), round_trip (the decoded text is the text)."""

    @F.pandas_udf("long")
    def crc(values):
        import pandas as pd

        return pd.Series([zlib.crc32(np.asarray(v, "<u4").tobytes()) for v in values])

    rows = decoded(encoded(docs, path), path)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), crc("ids").alias("ids_crc32"), F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"), (F.col("decoded") == F.replace("text", F.lit(MARK), F.lit(" "))).alias("round_trip"))
