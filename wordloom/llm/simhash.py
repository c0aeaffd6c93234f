"""SimHash near-dedup with covering locality-sensitive hashing.

Each bit position gets a non-zero vector of radius+1 bits; each non-zero vector v is a table, whose mask has the
positions with an odd inner product with v. Up to `radius` differing positions span at most `radius` dimensions, so
some v is orthogonal to all of them: in that table the two fingerprints collide. No pair within the radius is missed.

`near_groups` links fingerprints by their distance alone. Only distinct fingerprints enter the tables. In a bucket of up
to SMALL of them, all distances are computed and a spanning forest of the links leaves the task. Fingerprints of larger
buckets are linked exactly in another way: two are within radius 4 if and only if some word is within 2 of both, and all
that are within 2 of one word are within 4 of one another; so each writes its 2081 words, and those that share a word
are linked to the smallest. That work is in proportion to the fingerprints, however many share a bucket.

`kept_rows` links texts by the similarity of their sets of word shingles (Jaccard). A SimHash of a text's long words
goes through the covering tables (an edited word changes five shingles but one word); bands of least hashes of the
shingles stand beside them as tables of equality, since an added passage changes words as much as shingles. In each
bucket a sketch of one-bit least hashes measures all pairs, and the spanning forest of the closest pairs leaves the
task, as far as the sketch leaves open that they are similar enough; a bucket of over SMALL members is dealt into
blocks and each pair of blocks gives its forest, which holds the forest of the whole. Every pair of these forests is
then judged by the whole shingle sets of both texts. Links become components (graph.components).

Cases: null text counts as empty; a text without words has fingerprint zero and links like any other; fewer words
than the shingle are one shingle; equal fingerprints are one component whatever their number; null ids come first
(component_id is the smallest id that is not null, null if there is none); rows that repeat an id each get a row; an
empty table gives no rows. Other columns are not read by `near_groups` and pass through `kept_rows`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import few, prepare, salted_join, split_words, stored, stretches, whole_text
from wordloom.llm.graph import components

SEED = 42
#: Distinct fingerprints of a bucket that are compared with one another.
SMALL = 4096
#: Hashes whose bits are spread at a time.
CHUNK = 1 << 15


def fingerprint(text: str, words_in_shingle: int) -> int:
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= words_in_shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends + 1 - sizes)[: len(words) - words_in_shingle + 1].tolist()
    shingles = [joined[p:q] for p, q in zip(starts, ends[words_in_shingle - 1 :].tolist(), strict=True)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        votes += np.unpackbits(hashes[i : i + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words_in_shingle: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed integer)."""
    prepare(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fps = np.array([fingerprint(t, words_in_shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0).cast(pa.int64()), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def masks(radius: int) -> list[int]:
    """Signed 64-bit masks of the covering tables."""
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(64)]
    out = []
    for v in range(1, 2 ** (radius + 1)):
        mask = sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def _labels(near: np.ndarray) -> np.ndarray:
    """near: buckets x n x n. For each member, the first member of its component."""
    n = near.shape[1]
    label = np.broadcast_to(np.arange(n, dtype=np.int32), near.shape[:2]).copy()
    while True:
        new = label.copy()
        for i in range(0, n, 256):
            new[:, i : i + 256] = np.where(near[:, i : i + 256], label[:, None, :], n).min(axis=2)
        new = np.minimum(new, np.take_along_axis(new, new, axis=1))
        if (new == label).all():
            return label
        label = new


def _forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """fps: buckets x n. Places (bucket, member) of members, with the first of their component."""
    k, n = fps.shape
    near = np.zeros((k, n, n), bool)
    for i in range(0, n, 256):
        near[:, i : i + 256] = np.bitwise_count(fps[:, i : i + 256, None] ^ fps[:, None, :]) <= radius
    label = _labels(near)
    bucket, member = np.nonzero(label != np.arange(n))
    return bucket * n + member, bucket * n + label[bucket, member]


def _sized(lists: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Lists of the first column by their size: the size n, and places (lists x n) in the flattened column; at most
    about a million pairs of members at a time."""
    ends = lists.column(0).offsets.to_numpy()
    at, sizes = ends - ends[0], np.diff(ends)
    for n in np.unique(sizes):
        starts = at[:-1][sizes == n]
        step = max(1, (1 << 20) // max(1, int(n * n)))
        for k in range(0, len(starts), step):
            yield int(n), starts[k : k + step, None] + np.arange(n)


def links(prints: DataFrame, radius: int) -> DataFrame:
    """prints (node: a fingerprint; stored, nodes distinct) to links (a, b) of nodes, whose components are those of all
    pairs within the radius."""
    if radius % 2:
        raise ValueError("the radius is even here: buckets too large to compare are linked by words half way")
    tables = F.array(*[F.xxhash64(F.lit(t), F.col("node").bitwiseAND(F.lit(m))) for t, m in enumerate(masks(radius))])
    rows = _met(prints.select("node"), tables)

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            flat = b.column(0).flatten().to_numpy(zero_copy_only=False)
            for _, index in _sized(b):
                nodes = np.sort(flat[index], axis=1)  # the smallest node first, so that the roots of buckets agree
                x, y = _forest(nodes.view(np.uint64), radius)
                yield pa.record_batch([pa.array(nodes.reshape(-1)[x]), pa.array(nodes.reshape(-1)[y])], ["a", "b"])

    small = rows.filter(F.col("n") <= SMALL).groupBy("key").agg(F.collect_list("node").alias("node")).select("node").mapInArrow(compare, "a long, b long")
    flips = np.array([0] + [sum(1 << i for i in c) for k in range(1, radius // 2 + 1) for c in combinations(range(64), k)], np.uint64)

    def spread(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fps = b.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(fps), 64):
                words = (fps[i : i + 64].view(np.uint64)[:, None] ^ flips).reshape(-1).view(np.int64)
                yield pa.record_batch([pa.array(words), pa.array(np.repeat(fps[i : i + 64], len(flips)))], ["word", "node"])

    dense = rows.filter(F.col("n") > SMALL).select("node").distinct().mapInArrow(spread, "word long, node long")
    low = dense.groupBy("word").agg(F.min("node").alias("b"), F.max("node").alias("z")).filter("b < z").drop("z")
    star = dense.join(low, "word").select(F.col("node").alias("a"), "b")
    return small.unionByName(star).filter("a <> b").distinct()


def _met(nodes: DataFrame, tables: Column) -> DataFrame:
    """nodes (stored) with a key for each of their tables, where another node has that key too: key, n (nodes of the
    key) and the columns of nodes; stored. Keys alone shuffle first, so only nodes that meet others do."""
    spark = nodes.sparkSession
    # a stored table may be a few large files; its rows become many times as many here
    dealt = nodes.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), nodes.rdd.getNumPartitions()))
    keyed = stored(dealt.select("node", F.explode(tables).alias("key")), "keys")
    sizes = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "key-counts")
    met = salted_join(keyed, sizes, "key", "n")
    if nodes.columns == ["node"]:
        return stored(met.select("key", "n", "node"), "buckets")
    met = stored(met.select("node", "key", "n"), "met")
    own = met.select("node").distinct()
    some = nodes.join(own.hint("broadcast" if few(own) else "merge"), "node", "left_semi")
    return stored(met.join(some.hint("merge"), "node"), "buckets")


def near_groups(docs: DataFrame, words_in_shingle: int = 5, radius: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row: doc_id, fingerprint, component_id (the smallest id that links reach)."""
    rows = stored(fingerprints(docs, words_in_shingle, doc_id, text), "simhash")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies")), "distinct")
    roots = components(links(distinct.select(F.col("fp").alias("node")), radius))
    placed = distinct.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left")
    placed = stored(placed.select("fp", "low", "copies", F.coalesce("root", "fp").alias("root")), "placed")
    firsts = stored(placed.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("nodes")), "firsts")
    found = stored(salted_join(placed.select("fp", "copies", "root"), firsts, "root", "nodes").select("fp", "copies", "component_id"), "found")
    return salted_join(rows, found, "fp", "copies").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: For copies by similarity: words of a shingle, least similarity (Jaccard, of shingles), fingerprints that go through
#: the covering tables, least bytes of their words.
SHINGLE, SIMILARITY, FINDERS, LONG_WORD = 5, 0.8, 1, 5
#: Candidates by equality of a band: bands, and least hashes of shingles in each. Texts of similarity s share one with the
#: chance 1 - (1 - s^ROWS)^BANDS, whatever the kind of edit: 0.974 at 0.8, 0.05 at 0.4.
BANDS, ROWS = 12, 6
#: Bits of the sketch, one for each of as many least hashes: texts of similarity s differ in (1 - s)/2 of them.
SKETCH = 512
#: Differing bits that leave open a similarity of 0.8: the expected ones and two and a half standard deviations.
OPEN = int(SKETCH * (1 - SIMILARITY) / 2 + 2.5 * (SKETCH * (1 - SIMILARITY) * (1 + SIMILARITY) / 4) ** 0.5)
_RANDOM = np.random.default_rng(SEED)
ODD = _RANDOM.integers(0, 1 << 31, BANDS * ROWS + SKETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
FLIP = _RANDOM.integers(0, 1 << 32, BANDS * ROWS + SKETCH, dtype=np.uint32)
PLACE = _RANDOM.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Shingles whose least hashes are taken at a time (they fit a core's cache).
BLOCK = 32
#: A bit of a least hash that its size does not decide.
BIT = np.uint32(12)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(rows: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of all texts one after another: 64-bit hashes, whether they are long, and where each text ends."""
    distinct, index, ends = split_words(rows)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))
    long = np.fromiter(map(len, distinct), np.int64, len(distinct)) >= LONG_WORD
    return hashes[index], long[index], ends


def _least(x: np.ndarray) -> np.ndarray:
    """The least of each of the hashes of x."""
    low, held = np.full(len(ODD), 0xFFFFFFFF, np.uint32), np.empty((BLOCK, len(ODD)), np.uint32)
    for i in range(0, len(x), BLOCK):
        own = x[i : i + BLOCK]
        hashes = np.bitwise_xor(own[:, None], FLIP, out=held[: len(own)])
        hashes *= ODD
        np.minimum(low, hashes.min(axis=0), out=low)
    return low


def _majority(hashes: np.ndarray) -> np.uint64:
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        votes += np.unpackbits(hashes[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > len(hashes)).view(np.uint64)[0]


def signatures(rows: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """For each text: the SimHash of its distinct long words, or else of its shingles; the bands; the sketch (words of 64
    bits); and the set of its shingles (sorted 32-bit hashes)."""
    words, long, ends = _word_hashes(rows)
    rolled = np.zeros(len(words), np.uint64)
    for j, odd in enumerate(PLACE):
        rolled[: len(words) - j] += words[j:] * odd
    rolled = _mixed(rolled)
    prints, low, sets = np.zeros(len(rows), np.uint64), np.zeros((len(rows), len(ODD)), np.uint32), []
    for i, (p, q) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        if q - p >= SHINGLE:
            own = rolled[p : q - SHINGLE + 1]
        else:  # the whole sequence, which is never taken for a longer one
            own = _mixed(np.array([(words[p:q] * PLACE[: q - p]).sum() + np.uint64(q - p + 1)], np.uint64))
        sets.append(np.unique((own >> np.uint64(32)).astype(np.uint32)))
        low[i] = _least(sets[-1])
        telling = words[p:q][long[p:q]]
        prints[i] = _majority(np.unique(telling if len(telling) else own))
    bands = np.zeros((len(rows), BANDS), np.uint64)
    for r in range(ROWS):
        bands = _mixed(bands * np.uint64(31) + low[:, r : BANDS * ROWS : ROWS] + np.uint64(1))
    return prints, bands, np.packbits(((low[:, BANDS * ROWS :] >> BIT) & np.uint32(1)).astype(np.uint8), axis=1).view(np.uint64), sets


def signature(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Of one text: fingerprints that find candidates (of which the last BANDS by equality), and the sketch."""
    prints, bands, sketch, _ = signatures(pa.array([text], pa.large_string()))
    return np.concatenate([prints, bands[0]]), sketch[0]


def _closest(sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """sketches: buckets x n x words. The pairs (bucket, member, member) of forests of the closest pairs that are not
    too far apart: Prim's algorithm in all buckets at a time, with memory in proportion to the members."""
    k, n, _ = sketches.shape
    far = SKETCH + 1
    best, source, out = np.full((k, n), far, np.int64), np.zeros((k, n), np.int64), np.zeros((k, n), bool)
    each, now, pairs = np.arange(k), np.zeros(k, np.int64), []
    for _ in range(n - 1):
        out[each, now] = True
        apart = np.bitwise_count(sketches ^ sketches[each, now][:, None]).sum(axis=2, dtype=np.int64)
        closer = (apart < best) & (apart <= OPEN)
        best, source = np.where(closer, apart, best), np.where(closer, now[:, None], source)
        now = np.where(out, far + 1, best).argmin(axis=1)
        joined = best[each, now] <= OPEN
        pairs.append((each[joined], now[joined], source[each, now][joined]))
    return tuple(np.concatenate([p[i] for p in pairs]) for i in range(3)) if pairs else (each[:0], each[:0], each[:0])


def candidates(nodes: DataFrame) -> DataFrame:
    """nodes (node, fp, bands, sketch; stored, nodes distinct) to pairs (a > b) that may be similar: of all pairs that
    meet in a table and whose sketches leave it open, those that span their components by the closest pairs."""
    own = [F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(masks(4))]
    bands = [F.xxhash64(F.lit(-1 - t), F.get("bands", F.lit(t))) for t in range(BANDS)]
    rows = _met(nodes, F.array(*own, *bands)).select("key", "n", "node", "sketch")

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            nodes = b.column(0).flatten().to_numpy(zero_copy_only=False)
            sketches = np.frombuffer(b"".join(b.column(1).flatten().to_pylist()), np.uint64).reshape(-1, SKETCH // 64)
            for _, index in _sized(b):
                k, x, y = _closest(sketches[index])
                x, y = nodes[index[k, x]], nodes[index[k, y]]
                yield pa.record_batch([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], ["a", "b"])

    def compared(rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.groupBy(*keys).agg(F.collect_list("node").alias("node"), F.collect_list("sketch").alias("sketch")).select("node", "sketch").mapInArrow(compare, "a long, b long")

    # a block has 0.4 SMALL members on average, so that two of them seldom exceed SMALL
    blocks = F.ceil(F.col("n") / (0.4 * SMALL)).cast("int")
    dealt = rows.filter(F.col("n") > SMALL).withColumns({"blocks": blocks, "own": F.pmod(F.xxhash64("node"), blocks).cast("int")})
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: j != F.col("own"))
    met = dealt.withColumn("other", F.explode(others)).withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")})
    return compared(rows.filter(F.col("n") <= SMALL), ["key"]).unionByName(compared(met, ["key", "x", "y"])).distinct()


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b; stored), those whose sets (node, shingles) are similar."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    ends = stored(ends, "ends")
    sets = sets.join(ends.hint("broadcast" if few(ends) else "merge"), "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))
    for end in ("a", "b"):
        counts = pairs.groupBy(end).agg(F.count("*").alias("pairs"))
        own = stored(sets.join(counts.withColumnRenamed(end, "node").hint("merge"), "node"), "sets").select(F.col("node").alias(end), "pairs", F.col("shingles").alias(f"of_{end}"))
        pairs = salted_join(pairs, own, end, "pairs", narrow=False).drop("pairs")
        if end == "a":
            pairs = stored(pairs, "halves")
    both = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.filter(both >= F.lit(SIMILARITY) * (F.size("of_a") + F.size("of_b") - both)).select("a", "b")


def kept_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: of texts that are linked by similarity, those with the smallest id
    (a null id before all others). Rows of one id share its fate: if one of them stays, all do."""
    prepare(docs.sparkSession)
    names = docs.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = b.column(1).cast(pa.large_string())
            for i, j in stretches(texts):
                prints, bands, sketch, sets = signatures(texts[i:j])
                node = np.array([xxhash.xxh64_intdigest(s.tobytes()) >> 1 for s in sets], np.int64)
                ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
                yield pa.record_batch(
                    [
                        b.column(0)[i:j],
                        pa.array(node),
                        pa.array(prints.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS), pa.int32()), pa.array(bands.view(np.int64).reshape(-1))),
                        pa.array([s.tobytes() for s in sketch], pa.binary()),
                        pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int32))),
                    ],
                    ["doc_id", "node", "fp", "bands", "sketch", "shingles"],
                )

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    prints = stored(slim.mapInArrow(run, "doc_id long, node long, fp long, bands array<long>, sketch binary, shingles array<int>"), "signatures")
    firsts = [F.first(c).alias(c) for c in ("fp", "bands", "sketch")]
    nodes = stored(prints.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id")).alias("low"), F.count("*").alias("copies"), *firsts), "nodes")
    pairs = stored(candidates(nodes.select("node", "fp", "bands", "sketch")), "pairs")
    roots = components(similar(pairs, prints.select("node", "shingles")))
    placed = nodes.select("node", "low", "copies").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    # a group's smallest id, and the node that has it; several nodes may share an id
    best = placed.groupBy("root").agg(F.min(F.struct("low", "node", "copies")).alias("best"))
    best = stored(best.select("best.node", "best.copies", F.col("best.low.doc_id").alias("wl_id")), "best")
    told = stored(salted_join(prints.select("doc_id", "node"), best, "node", "copies").filter(F.col("doc_id").eqNullSafe(F.col("wl_id"))).select("wl_id").distinct(), "told")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("wl_row"), F.col(doc_id).cast("long").alias("wl_key"))
    gone = stored(prints.select(F.col("doc_id").alias("wl_id")).distinct().join(told.withColumnRenamed("wl_id", "wl_told"), F.col("wl_id").eqNullSafe(F.col("wl_told")), "left_anti"), "gone")
    if few(gone):
        return whole.join(F.broadcast(gone), F.col("wl_key").eqNullSafe(F.col("wl_id")), "left_anti").select("wl_row.*")
    return whole.join(told, F.col("wl_key").eqNullSafe(F.col("wl_id")), "left_semi").select("wl_row.*")


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return near_groups(docs, words_in_shingle=4, radius=4)
