"""Language-model scores of a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(group | history) P(class | group, history) P(word | class). The history gives three features, each
hashed into buckets: the word before, the word before that (a skip) and both together. There are as many buckets as the
training tokens call for, up to the bound of what is broadcast. Class weights start at zero and are trained by gradient updates that are
distributed: in a pass every partition goes through its documents in sparse numpy batches, from the weights it was
sent, and steps against the gradient after each (step sizes by the sum of squared gradients so far); a tree then takes
the mean of the partitions' weights, each row of weights by the tokens that it has met. Passes are made until the loss
settles: until the last quarter of a pass is no more than TOLERANCE better than the quarter before it. The SINGLES most
frequent words are classes of one word; all other words fall into buckets by their last letters, and buckets into
classes by the frequent words that stand before them (k-means). It is a class model: within a class words have their
training frequency, with half a count more, and half a count for all unknown words, whatever the history.

A word is known by 64 bits: 54 of its XXH64 and 10 of the hash of its last three bytes. Counts cover all training
documents. Frequent words (at most HEAD, broadcast) are looked up in place; only rarer words shuffle to meet their
counts, and a key with many of them is dealt over several tasks.

Cases: null text counts as empty and is the end token alone; a null id counts as the empty string for the split; rows
that repeat an id each get a row; with no training rows all is unknown (N and V are 0) and classes are even; an empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import merged, places, prepare, salted_join, split_words, stored, stretches, whole_text

SUFFIXES, SINGLES, CLASSES = 1024, 31, 64
#: Classes stand in groups of SIDE; rows and numbers of a bucket's weights: for the groups, and for the classes of each.
SIDE, GROUPS = 8, 8
ROWS, WIDTH = 1 + GROUPS, (1 + GROUPS) * SIDE
#: Fewest buckets, training tokens for one more, and most buckets (weights of 3 x 72 x 4 bytes each are broadcast: 57 MB).
BUCKETS, BUCKET_TOKENS, MOST_BUCKETS = 1 << 14, 4096, 1 << 16
HEAD = 1 << 19
#: Step size, what the sum of squared gradients starts with, the gain of a quarter of a pass that counts as settled, and
#: the most passes (a table of a few batches needs many).
STEP, CALM, TOLERANCE, PASSES = 0.3, 0.1, 0.02, 12
#: Tokens of a gradient step or scored at a time (their logits fit a core's cache); numbers in a mergeable piece.
CHUNK, PIECE = 1 << 13, 1 << 17
END, START = np.uint64(xxhash.xxh64_intdigest(b"\n")) & ~np.uint64(SUFFIXES - 1), np.uint64(0)
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
#: Words that are counted together before their counts are sent on.
ROOM = 1 << 22


def _key(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) & ~(SUFFIXES - 1) | xxhash.xxh32_intdigest(word[-3:]) & (SUFFIXES - 1)


def tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id, held_out, keys (64-bit words, little-endian, with the end)."""
    prepare(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i, j in stretches(b.column(2)):
                distinct, index, ends = split_words(b.column(2)[i:j])
                keys = np.insert(np.fromiter(map(_key, distinct), np.uint64, len(distinct))[index], ends[1:], END)
                at = pa.array((ends + np.arange(len(ends))) * 8, pa.int32())
                out = pa.Array.from_buffers(pa.binary(), j - i, [None, at.buffers()[1], pa.py_buffer(keys)])
                yield pa.record_batch([b.column(0)[i:j].cast(pa.int64()), b.column(1)[i:j], out], ["doc_id", "held_out", "keys"])

    held = F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1
    got = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held.alias("held_out"), whole_text(text).alias("text")).mapInArrow(run, "doc_id long, held_out boolean, keys binary")
    return stored(got.withColumn("row", F.monotonically_increasing_id()), "lm-tokens")


def _flat(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all documents one after another, and where each ends."""
    at, size = places(values)
    keys = np.frombuffer(values.buffers()[2], np.uint64, int(size.sum()) // 8, int(at[0])) if len(values) else np.zeros(0, np.uint64)
    return keys, np.cumsum(size) // 8


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order of their first places, and which of them each key is."""
    import pandas as pd

    index, distinct = pd.factorize(keys.view(np.int64))
    return distinct.view(np.uint64), index


def counts(train: DataFrame) -> DataFrame:
    """key, n over all training documents."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, room = [], 0

        def counted() -> pa.RecordBatch:
            keys, index = _distinct(np.concatenate(held))
            return pa.record_batch([pa.array(keys.view(np.int64)), pa.array(np.bincount(index, minlength=len(keys)))], ["key", "n"])

        for b in it:
            held.append(_flat(b.column(0))[0].copy())
            room += len(held[-1])
            if room > ROOM:  # sent on, to be added up with the rest
                yield counted()
                held, room = [], 0
        if room:
            yield counted()

    return stored(train.select("keys").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "lm-counts")


def _history(keys: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one = np.concatenate([[START], keys[:-1]])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    one[starts] = START
    two = np.concatenate([[START], one[:-1]])
    two[starts] = START
    return one, two


def features(keys: np.ndarray, ends: np.ndarray, buckets: int = BUCKETS) -> list[np.ndarray]:
    """The buckets (a power of two of them) of the three features of each token."""
    one, two = _history(keys, ends)
    shift = np.uint64(64 - int(math.log2(buckets)))
    with np.errstate(over="ignore"):
        a, b = one * MIX[0], two * MIX[1]
        return [((x >> shift).astype(np.int64)) for x in (a, b, ((a ^ (b >> np.uint64(7))) * MIX[2]))]


def _put(table: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """table[rows] = values, a row of SIDE numbers as one item."""
    kind = np.dtype((np.void, table.itemsize * SIDE))
    table.view(kind).reshape(-1)[rows] = values.view(kind).reshape(-1)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of stretches of rows, which begin at `starts`."""
    reach = np.take(np.cumsum(values, axis=0, dtype=np.float64), np.append(starts[1:], len(values)) - 1, axis=0)
    reach[1:] -= reach[:-1].copy()
    return reach.astype(np.float32)


class Model:
    """Classes in GROUPS groups: P(class | history) = P(group | history) P(class | group, history). The weights of a bucket
    are WIDTH / SIDE rows of SIDE numbers: one for the groups, and one for the classes of each group."""

    def __init__(self, singles: np.ndarray, bucket_class: np.ndarray, buckets: int = BUCKETS):
        self.buckets = buckets
        order = np.argsort(singles)
        self.singles, self.single_class = singles[order], order
        self.bucket_class = bucket_class
        self.bias = np.zeros((1 + GROUPS, SIDE), np.float32)
        self.weights = np.zeros((3, buckets, WIDTH), np.float32)

    def classes(self, keys: np.ndarray) -> np.ndarray:
        out = self.bucket_class[(keys & np.uint64(SUFFIXES - 1)).astype(np.int64)]
        if len(self.singles):
            at = np.minimum(np.searchsorted(self.singles, keys), len(self.singles) - 1)
            hit = self.singles[at] == keys
            out = np.where(hit, self.single_class[at], out)
        return out

    def _softmax(self, feats: list[np.ndarray], row: np.ndarray | int) -> np.ndarray:
        """Of a row (0: groups, 1 and on: the classes of a group) of each token's buckets."""
        rows = self.weights.reshape(3, -1, SIDE)
        logits = np.take(rows[0], feats[0] * ROWS + row, axis=0)
        logits += np.take(rows[1], feats[1] * ROWS + row, axis=0)
        logits += np.take(rows[2], feats[2] * ROWS + row, axis=0)
        logits += np.take(self.bias, row, axis=0)
        np.exp(np.minimum(logits, 60, out=logits), out=logits)
        logits /= (logits @ np.ones(SIDE, np.float32))[:, None]
        return logits

    def probabilities(self, feats: list[np.ndarray]) -> np.ndarray:
        """Of all classes."""
        group = self._softmax(feats, 0)
        return np.concatenate([group[:, [g]] * self._softmax(feats, g + 1) for g in range(GROUPS)], axis=1)

    def of_class(self, feats: list[np.ndarray], y: np.ndarray) -> np.ndarray:
        """Of one class each."""
        each, g = np.arange(len(y)), y // SIDE
        return self._softmax(feats, 0)[each, g] * self._softmax(feats, g + 1)[each, y % SIDE]

    def step(self, feats: list[np.ndarray], y: np.ndarray, squares: np.ndarray) -> float:
        """One update by these tokens; the sum of their losses before it."""
        each, g, member = np.arange(len(y)), y // SIDE, y % SIDE
        group, inner = self._softmax(feats, 0), self._softmax(feats, g + 1)
        loss = -np.log(np.maximum(group[each, g] * inner[each, member], 1e-30)).sum(dtype=np.float64)
        group[each, g] -= 1
        inner[each, member] -= 1
        weights, squares = self.weights.reshape(3, -1, SIDE), squares.reshape(3, -1, SIDE)
        by_group = np.argsort(g.astype(np.uint8), kind="stable")
        for k, f in enumerate(feats):
            # by radix, since buckets fit 16 bits: sorted by bucket and group, so that one order serves both rows
            order = by_group[np.argsort(f[by_group].astype(np.uint16), kind="stable")]
            at = f[order] * ROWS
            within = at + 1 + g[order]
            starts, parts = (np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) for x in (at, within))
            gradient = np.concatenate([_sums(np.take(group, order, axis=0), starts), _sums(np.take(inner, order, axis=0), parts)])
            rows = np.concatenate([at[starts], within[parts]])
            own = np.take(squares[k], rows, axis=0)
            own += gradient * gradient
            _put(squares[k], rows, own)
            gradient *= STEP / np.sqrt(own)
            _put(weights[k], rows, np.take(weights[k], rows, axis=0) - gradient)
        return float(loss)


def _gathered(train: DataFrame, shape: tuple[int, ...], add) -> np.ndarray:
    """Sum over all partitions of the array that add(array, keys, ends) fills."""
    size = math.prod(shape)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.float32)
        for b in it:
            keys, ends = _flat(b.column(0))
            if len(keys):
                add(total, keys, ends)
        flat, part = total.reshape(-1), TaskContext.get().partitionId()
        for i in range(0, size, PIECE):
            if flat[i : i + PIECE].any():
                yield pa.record_batch([pa.array([i // PIECE], pa.int64()), pa.array([part], pa.int64()), pa.array([flat[i : i + PIECE].astype("<f4").tobytes()], pa.binary())], ["piece", "part", "value"])

    rows = train.select("keys")
    made = merged(rows.mapInArrow(run, "piece long, part long, value binary"), "piece", "part", ["value"], _added, rows.rdd.getNumPartitions()).collect()
    out = np.zeros(-(-size // PIECE) * PIECE, np.float64)
    for r in made:
        value = np.frombuffer(bytes(r.value), "<f4")
        out[r.piece * PIECE : r.piece * PIECE + len(value)] = value
    return out[:size].reshape(shape)


def _added(rows: list[tuple]) -> tuple[bytes]:
    total = np.zeros(len(rows[0][0]) // 4, np.float64)
    for (value,) in rows:
        total += np.frombuffer(value, "<f4")
    return (total.astype("<f4").tobytes(),)


def _bucket_classes(train: DataFrame, singles: np.ndarray) -> np.ndarray:
    """Suffix buckets to classes, by the frequent words that stand up to three words before them."""
    known = np.sort(singles)
    width = len(known) + 1

    def add(total: np.ndarray, keys: np.ndarray, ends: np.ndarray) -> None:
        at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
        column = np.where(known[at] == keys, at, len(known)) if len(known) else np.zeros(len(keys), np.int64)
        bucket = (keys & np.uint64(SUFFIXES - 1)).astype(np.int64)
        starts = np.zeros(len(keys), np.int64)
        starts[ends[:-1][ends[:-1] < len(keys)]] = 1
        doc = np.cumsum(starts)
        for lag in (1, 2, 3):
            same = doc[lag:] == doc[:-lag]
            total += np.bincount((bucket[lag:] * width + column[:-lag])[same], minlength=SUFFIXES * width).reshape(SUFFIXES, width).astype(np.float32)

    table = _gathered(train, (SUFFIXES, width), add)
    mass = table.sum(axis=1)
    vectors = np.sqrt((table + 1e-9) / (mass[:, None] + 1e-9 * width))
    overall = np.sqrt((table.sum(axis=0) + 1e-9) / (mass.sum() + 1e-9 * width))
    vectors = np.where(mass[:, None] > 0, vectors, overall) - overall
    groups = CLASSES - SINGLES
    order = np.argsort(-mass, kind="stable")
    centres = [vectors[order[0]]]
    for _ in range(groups - 1):  # far and heavy buckets first
        far = np.min([((vectors - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(vectors[int(np.argmax(far * mass))])
    centres = np.array(centres)
    for _ in range(20):
        label = ((vectors[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in range(groups):
            own = (label == g) * (mass + 1e-9)
            if own.sum() > 0:
                centres[g] = (vectors * own[:, None]).sum(axis=0) / own.sum()
    return SINGLES + label


def _head(table: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys and counts of up to HEAD words that are counted at least as often as all others, and that least count."""
    steps = table.groupBy(F.floor(4 * F.log2("n")).alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect()
    total, least = 0, None
    for r in steps:
        if (total := total + r.words) > HEAD:
            break
        least = r.step
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), 1 << 62
    rows = table.filter(F.floor(4 * F.log2("n")) >= least).toPandas()
    keys, n = rows["key"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    order = np.argsort(keys)
    return keys[order], n[order], least


def _mean(rows: list[tuple]) -> tuple[bytes, bytes]:
    """Weights (half precision) with the tokens that each row of them has met: their mean by these. Without such, sums."""
    if not rows[0][1]:
        return np.sum([np.frombuffer(v, "<f8") for v, _ in rows], axis=0).tobytes(), b""
    met = np.zeros(len(rows[0][1]) // 4, np.float64)
    total = np.zeros((len(met), WIDTH), np.float64)
    for value, n in rows:
        n = np.frombuffer(n, "<f4").astype(np.float64)
        total += np.frombuffer(value, "<f2").reshape(-1, WIDTH) * n[:, None]
        met += n
    return (total / np.maximum(met, 1)[:, None]).astype("<f2").tobytes(), met.astype("<f4").tobytes()


def trained(train: DataFrame, model: Model) -> tuple[Model, list[list[float]]]:
    """The model with its weights trained, and for each pass the mean loss of its quarters."""
    spark = train.sparkSession
    rows = train.select("keys")
    parts, losses = rows.rdd.getNumPartitions(), []
    share = PIECE // WIDTH
    while len(losses) < PASSES:
        known = spark.sparkContext.broadcast(model)

        def run(it: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            sent = known.value
            own = Model(sent.singles[np.argsort(sent.single_class)], sent.bucket_class, sent.buckets)
            own.bias, own.weights = sent.bias, sent.weights.copy()
            squares = np.full(own.weights.shape, CALM, np.float32)
            met = np.zeros(own.weights.shape[:2], np.float32)
            steps = []
            for b in it:
                keys, ends = _flat(b.column(0))
                if not len(keys):
                    continue
                distinct, index = _distinct(keys)
                y, feats = own.classes(distinct)[index], features(keys, ends, own.buckets)
                for k, f in enumerate(feats):
                    met[k] += np.bincount(f, minlength=own.buckets)
                for i in range(0, len(keys), CHUNK):
                    steps.append((own.step([f[i : i + CHUNK] for f in feats], y[i : i + CHUNK], squares), min(CHUNK, len(keys) - i)))
            if not steps:
                return
            part, quarters = TaskContext.get().partitionId(), np.zeros(8)
            for i, (loss, n) in enumerate(steps):
                quarters[[4 * i // len(steps), 4 + 4 * i // len(steps)]] += loss, n
            out = [(-1, quarters.astype("<f8").tobytes(), b"")]
            weights, met = own.weights.reshape(-1, WIDTH), met.reshape(-1)
            out += [(i // share, weights[i : i + share].astype("<f2").tobytes(), met[i : i + share].astype("<f4").tobytes()) for i in range(0, len(met), share)]
            for piece, value, n in out:
                yield pa.record_batch([pa.array([piece], pa.int64()), pa.array([part], pa.int64()), pa.array([value], pa.binary()), pa.array([n], pa.binary())], ["piece", "part", "value", "met"])

        made = merged(rows.mapInArrow(run, "piece long, part long, value binary, met binary"), "piece", "part", ["value", "met"], _mean, parts).collect()
        if not made:
            break
        weights = model.weights.reshape(-1, WIDTH).copy()
        for r in made:
            if r.piece < 0:
                quarters = np.frombuffer(bytes(r.value), "<f8")
            else:
                value, n = np.frombuffer(bytes(r.value), "<f2").reshape(-1, WIDTH), np.frombuffer(bytes(r.met), "<f4")
                at = r.piece * share + np.flatnonzero(n)
                weights[at] = value[n > 0]
        model.weights = weights.reshape(model.weights.shape)
        losses.append((quarters[:4] / np.maximum(quarters[4:], 1)).tolist())
        third, last = losses[-1][2:]
        if third and last and third - last <= TOLERANCE * third:
            break
    return model, losses


def fitted(train: DataFrame, table: DataFrame, head: tuple[np.ndarray, np.ndarray, int], n_all: int) -> tuple[Model, np.ndarray, list[list[float]]]:
    """The model, the log10 of what each class holds (0 for a class of one word), and the losses of its training."""
    singles = head[0][np.lexsort((head[0], -head[1]))][:SINGLES]
    buckets = min(MOST_BUCKETS, max(BUCKETS, 1 << int(n_all // BUCKET_TOKENS).bit_length()))
    model = Model(singles, _bucket_classes(train, singles), buckets)
    # what each class holds besides the singles
    sums = table.groupBy(F.col("key").bitwiseAND(F.lit(SUFFIXES - 1)).alias("bucket")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()
    mass, words, own = np.zeros(SUFFIXES), np.zeros(SUFFIXES), np.zeros(CLASSES)
    for r in sums:
        mass[r.bucket], words[r.bucket] = r.n, r.words
    known = set(singles.tolist())
    for k, c in zip(head[0].tolist(), head[1].tolist(), strict=True):
        if k in known:
            mass[k % SUFFIXES] -= c
            words[k % SUFFIXES] -= 1
            own[model.classes(np.array([k], np.uint64))[0]] += c
    below = np.zeros(CLASSES)
    np.add.at(below, model.bucket_class, mass + 0.5 * words)
    np.add.at(own, model.bucket_class, mass)
    share = ((own + 1) / (own.sum() + CLASSES)).reshape(GROUPS, SIDE)
    model.bias = np.log(np.concatenate([share.sum(axis=1)[None], share / share.sum(axis=1, keepdims=True)])).astype(np.float32)
    in_class = np.log10(below + 0.5)
    in_class[: len(singles)] = 0
    model, losses = trained(train, model)
    return model, in_class, losses


def scored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = tokens(docs, doc_id, text)
    train = rows.filter("not held_out")
    table = counts(train)
    n_all, n_words = (x or 0 for x in table.agg(F.sum("n"), F.count("*")).first())
    head = _head(table)
    model, in_class, _ = fitted(train, table, head, n_all)
    known = spark.sparkContext.broadcast((model, head[0], np.log10(head[1] + 0.5), in_class))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, head, logs, in_class = known.value
        for b in it:
            keys, ends = _flat(b.column(1))
            if not len(keys):
                continue
            distinct, index = _distinct(keys)
            at = np.minimum(np.searchsorted(head, distinct), max(len(head) - 1, 0))
            hit = head[at] == distinct if len(head) else np.zeros(len(distinct), bool)
            log_n = np.where(hit, logs[at], 0.0) if len(head) else np.zeros(len(distinct))
            classes = model.classes(distinct)
            rest = np.where(classes < len(model.singles), -log_n, -in_class[classes])
            y, feats = classes[index], features(keys, ends, model.buckets)
            log_class = np.empty(len(keys))
            for i in range(0, len(keys), CHUNK):
                log_class[i : i + CHUNK] = np.log10(np.maximum(model.of_class([f[i : i + CHUNK] for f in feats], y[i : i + CHUNK]), 1e-30))
            starts = np.concatenate([[0], ends[:-1]])
            total = lambda x: np.add.reduceat(x, starts)  # noqa: E731  every document has its end
            rare = np.flatnonzero(~hit[index])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, np.concatenate([[0], ends])), pa.int32()), pa.array(keys[rare].view(np.int64)))
            out = [b.column(0), pa.array(np.diff(ends, prepend=0)), pa.array(total(hit[index].astype(np.int64))), pa.array(total(log_n[index])), pa.array(total(log_class + rest[index])), lists]
            yield pa.record_batch(out, ["row", "n_tokens", "hits", "log_n", "log_rest", "rare"])

    main = stored(rows.select("row", "keys").mapInArrow(run, "row long, n_tokens long, hits long, log_n double, log_rest double, rare array<long>"), "lm-scores")
    rare = stored(main.select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count("*").alias("times")), "lm-rare")
    met = rare.groupBy("key").agg(F.count("*").alias("rows")).join(table.filter(F.floor(4 * F.log2("n")) < head[2]), "key", "left")
    rare = salted_join(rare, stored(met, "lm-met"), "key", "rows").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_n"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_hits"))
    both = rows.select("row", "doc_id", "held_out").join(main.drop("rare"), "row").join(rare, "row", "left")
    log_n = F.col("log_n") + F.coalesce("rare_n", F.lit(0.0))
    return both.select("doc_id", "held_out", "n_tokens", (F.col("hits") + F.coalesce("rare_hits", F.lit(0))).cast("long").alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"), (log_n - F.col("n_tokens") * math.log10(n_all + 0.5 * (n_words + 1))).alias("base_score"), (log_n + F.col("log_rest")).alias("score"))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return scored(docs)
