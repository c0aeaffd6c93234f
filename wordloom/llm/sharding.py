"""Sharding by sampled splitters.

Rows are ordered by (hash of text, hash of id, id), so that equal texts lie together. Size-weighted samples of these
keys are drawn (each row with a chance in proportion to its size), their quantiles part the order into many ranges,
and ranges that turn out overfull in bytes or rows are subdivided by new samples from within. A range is small, so a
window over it is; the sizes of all ranges then give each row the exact number of bytes before it, and shards are
the stretches between multiples of total/shards. That is the law `bytes`: the sizes of two shards differ by less than
two rows. Equal texts share a shard unless a cut falls between them, as it must where they are a third of all rows.

Cases: null text has no bytes, size 1 and the crc32 of the empty text; null ids sort first; rows alike in all three
columns are rows of their own, in any order among themselves; an empty table gives no rows. Other columns are not read
by `assigned` and pass through `sharded`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.llm.common import prepare, stored, whole_text

#: Fewest ranges; rows that a range holds on average at most, until there are the most ranges; samples for a range;
#: rounds of subdividing. Samples, splitters and sums of ranges on the driver are bounded by these.
RANGES, RANGE_ROWS, MOST_RANGES, SAMPLES, ROUNDS = 256, 500_000, 1 << 16, 24, 3
KEY = ["wl_h", "wl_g"]


def _load(mean: float) -> Column:
    """What fills a range: bytes, and rows at the mean size, so that neither piles up."""
    return F.col("size") + F.lit(float(mean))


def _uniform(seed: int) -> Column:
    return (F.xxhash64(F.lit(seed), "wl_h", "wl_g", "size").bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)


def _sample(rows: DataFrame, share: Column, seed: int) -> np.ndarray:
    """Keys with their weights over their chances: about sum(share) rows."""
    drawn = rows.withColumn("wl_p", F.least(share, F.lit(1.0))).filter(_uniform(seed) < F.col("wl_p")).select("wl_range", *KEY, (F.col("wl_load") / F.col("wl_p")).alias("w")).toPandas()
    out = np.zeros(len(drawn), [("range", "<i8"), ("h", "<i8"), ("g", "<i8"), ("w", "<f8")])
    out["range"], out["h"], out["g"], out["w"] = drawn["wl_range"], drawn["wl_h"], drawn["wl_g"], drawn["w"]
    return np.sort(out, order=["range", "h", "g"])


def _quantiles(sample: np.ndarray, parts: int) -> list[tuple[int, int]]:
    """Up to parts-1 keys that part the sample evenly by weight."""
    if not len(sample) or parts < 2:
        return []
    reach = np.cumsum(sample["w"])
    at = np.searchsorted(reach, reach[-1] * np.arange(1, parts) / parts)
    return sorted({(int(sample["h"][i]), int(sample["g"][i])) for i in np.minimum(at, len(sample) - 1)})


def _ranged(rows: DataFrame, splitters: list[tuple[int, int]]) -> DataFrame:
    """wl_range: the number of splitters up to the key. The splitters are as many as the ranges, which are bounded."""
    h = np.array([s[0] for s in splitters], np.int64)
    g = np.array([s[1] for s in splitters], np.int64)
    known = rows.sparkSession.sparkContext.broadcast((h, g))

    @F.pandas_udf("long")
    def place(a, b):
        import pandas as pd

        h, g = known.value
        x, y = a.to_numpy(np.int64), b.to_numpy(np.int64)
        low, high = np.searchsorted(h, x, "left"), np.searchsorted(h, x, "right")
        out = low.copy()
        many = np.flatnonzero(high > low)
        for i in many[np.argsort(low[many], kind="stable")]:  # several splitters share this hash: a hot text
            out[i] = low[i] + np.searchsorted(g[low[i] : high[i]], y[i], "right")
        return pd.Series(out)

    return rows.withColumn("wl_range", place("wl_h", "wl_g"))


def _ranges(rows: DataFrame, total: float, count: int) -> list[tuple[int, int]]:
    parts = min(MOST_RANGES, max(RANGES, -(-count // RANGE_ROWS)))
    whole = rows.withColumn("wl_range", F.lit(0).cast("long"))
    splitters = _quantiles(_sample(whole, F.col("wl_load") * (parts * SAMPLES / total), 0), parts)
    limit = 2 * total / parts
    for seed in range(1, ROUNDS + 1):
        ranged = _ranged(rows, splitters)
        full = ranged.groupBy("wl_range").agg(F.sum("wl_load").alias("load"), F.count("*").alias("n")).filter((F.col("load") > limit) & (F.col("n") > 1)).collect()  # at most parts/2
        if not full:
            break
        known = F.broadcast(rows.sparkSession.createDataFrame([(r.wl_range, float(r.load)) for r in full], "wl_range long, wl_full double"))
        sample = _sample(ranged.join(known, "wl_range"), F.col("wl_load") * (SAMPLES * 2 / limit), seed)
        new = set(splitters)
        for r in full:
            own = sample[sample["range"] == r.wl_range]
            new.update(_quantiles(own, int(2 * r.load / limit) + 2))
        if len(new) == len(splitters):
            break
        splitters = sorted(new)
    return splitters


def assigned(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", own: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row, and the columns named in `own`."""
    prepare(docs.sparkSession)
    spark = docs.sparkSession
    body = whole_text(text)
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("wl_h"), *own)
    slim = stored(slim.withColumn("wl_g", F.xxhash64("doc_id")), "sizes")
    count, total = slim.agg(F.count("*"), F.sum("size")).first()
    if not count:
        return slim.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), *own)
    rows = slim.withColumn("wl_load", _load(total / count))
    rows = stored(_ranged(rows, _ranges(rows, 2.0 * total, count)), "ranged")
    sums = rows.groupBy("wl_range").agg(F.sum("size").alias("b"), F.count("*").alias("n")).orderBy("wl_range").collect()  # as many as the ranges
    before, offsets = [0, 0], []
    for r in sums:
        offsets.append((r.wl_range, *before))
        before = [before[0] + r.b, before[1] + r.n]
    offsets = F.broadcast(spark.createDataFrame(offsets, "wl_range long, wl_bytes long, wl_rows long"))
    order = Window.partitionBy("wl_range").orderBy("wl_h", "wl_g", F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    placed = rows.withColumns({"wl_sum": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)), "wl_nth": F.row_number().over(order)}).join(offsets, "wl_range")
    middle = F.col("wl_bytes") + F.col("wl_sum") - F.col("size") + F.expr("size div 2")
    shard = F.least(F.lit(shards - 1), F.floor(middle.cast("decimal(38,0)") * shards / F.lit(total).cast("decimal(20,0)"))).cast("int")
    placed = stored(placed.select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("wl_rows") + F.col("wl_nth") - 1).alias("wl_rank"), *own), "placed")
    firsts = F.broadcast(placed.groupBy("shard").agg(F.min("wl_rank").alias("wl_first")))  # one row a shard
    return placed.join(firsts, "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("wl_rank") - F.col("wl_first")).alias("slot"), *own)


def write_shards(docs: DataFrame, shards: int, path: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the rows of docs, with all columns, to path/wl_shard=0 and on, in order of their slots. Rows alike in
    id and text have places of their own."""
    rows = stored(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("wl_row"), F.col(doc_id).cast("long").alias("wl_id"), whole_text(text).alias("wl_text")).withColumn("wl_pos", F.monotonically_increasing_id()), "rows")
    where = assigned(rows.drop("wl_row"), shards, "wl_id", "wl_text", ("wl_pos",)).select("wl_pos", F.col("shard").alias("wl_own_shard"), F.col("slot").alias("wl_slot"))
    joined = rows.select("wl_pos", "wl_row").join(where.hint("merge"), "wl_pos").select("wl_row.*", "wl_own_shard", "wl_slot")
    if "wl_shard" in docs.columns:
        raise ValueError("wl_shard is the name of the folders: rename the column")
    ordered = joined.repartitionByRange(max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "wl_own_shard", "wl_slot").sortWithinPartitions("wl_own_shard", "wl_slot")
    ordered.drop("wl_slot").withColumnRenamed("wl_own_shard", "wl_shard").write.partitionBy("wl_shard").parquet(path)


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    got = assigned(docs, 8)
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
