import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.operators import archive
from wordloom.sources import controlled


@pytest.mark.parametrize("case", controlled.CASES)
def test_controlled_tensors_round_trip(spark, case):
    words = controlled.generate(spark, case, words=1000)
    assert words.filter("w < 0 or w > 65535").count() == 0
    rows = words.groupBy(F.lit(0).cast("long").alias("tensor"), "r").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "w"))), lambda x: x.w).alias("ws"))
    ragged = rows.filter("size(ws) = 64")
    tiles = archive.compress(ragged).cache()
    got = archive.verified(ragged, archive.decompress(tiles)).first()
    assert (got.n_words, got.differing) == (960, 0)
    modes = {r.mode_name for r in tiles.collect()}
    if case == "constant_block":
        assert modes == {"constant"}
    if case == "random":
        assert modes == {"raw"}
    if case == "previous_row":
        assert modes == {"prev_row"}


@pytest.mark.parametrize("n", [1, 2, 17, 255, 256, 257, 1024])
def test_tiles_of_any_length(n):
    rng = np.random.default_rng(n)
    for words in (rng.integers(0, 65536, (1, n)), rng.integers(0, 3, (1, n)), np.full((1, n), 9), np.where(rng.random((1, n)) < 0.05, 7, 1000)):
        name, payload = archive.encode_tile(words)
        assert len(payload) <= 2 * n
        assert (archive.decode_tile(name, payload, 1, n) == words).all()


def test_corrupt_tiles_are_refused(spark):
    rows = spark.createDataFrame([(0, r, list(range(r, r + 64))) for r in range(8)], "tensor long, r long, ws array<long>")
    tiles = archive.compress(rows).withColumn("payload", F.concat(F.col("payload"), F.lit(b"x")))
    with pytest.raises(Exception, match="corrupt"):
        archive.decompress(tiles).collect()


def test_verified_sees_what_is_missing(spark):
    rows = spark.createDataFrame([(0, r, [1, 2, 3]) for r in range(4)], "tensor long, r long, ws array<long>")
    got = archive.verified(rows, rows.filter("r > 0")).first()
    assert (got.n_words, got.differing) == (12, 3)


def test_manifest(spark):
    got = {r["case"]: r for r in controlled.manifest(spark).collect()}
    assert len(got) == 10 and all(r.words == 4096 and r.byte_count == 8192 for r in got.values())
    assert got["constant_block"].distinct_words == 1 and got["repeated_residuals"].distinct_words == 3
