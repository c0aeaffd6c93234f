"""Each definition in Spark against its DuckDB spelling on the same tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from wordloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(catalog.oracle_sql())


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def same(rows, names):
    return sorted(repr(tuple(round(v, 5) if isinstance(v, float) else v for v in (row[names.index(n)] for n in sorted(names)))) for row in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_duckdb(spark, duck, data, name):
    df = catalog.queries()[name](spark, data)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert same([tuple(r) for r in df.collect()], df.columns) == same(want.fetchall(), list(want.columns))


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    """Embeddings of two tensors with 20 exponents of a word each and 12 of growing numbers, in no order: their best codes
    take up to 17 bits, and codes of 16 bits cost 80 bits more."""
    many = [1, 1]
    while len(many) < 12:
        many.append(many[-1] + many[-2])
    counts = [1] * 20 + [40 * n + 1 for n in many]
    counts[-1] += -sum(counts) % 64
    exponents = np.repeat(np.arange(100, 132), counts).astype(np.uint32)
    rng, rows = np.random.default_rng(7), []
    for label in (0, 1):
        bits = rng.permutation(exponents) << 23 | rng.integers(0, 128, len(exponents), np.uint32) << 16
        rows += [(label, v) for v in bits.view(np.float32).reshape(-1, 64)]
    path = tmp_path_factory.mktemp("skewed")
    pd.DataFrame({"vec_id": np.arange(len(rows)), "embedding": [v for _, v in rows], "label": np.array([t for t, _ in rows], np.int32)}).to_parquet(path / "embeddings.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["huffman_roundtrip", "whole_or_tiles", "profile_sizes"])
def test_codes_longer_than_16_bits_match_duckdb(spark, skewed, name):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{skewed}/embeddings.parquet'")
    df, want = catalog.queries()[name](spark, skewed), con.sql(catalog.oracle_sql()[name])
    assert same([tuple(r) for r in df.collect()], df.columns) == same(want.fetchall(), list(want.columns))


def test_entry_and_queries_agree(spark, data):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "qualify_leaderboard" in entry.queries()
    got = entry.entry(spark)
    assert got.columns == ["tensor", "n_words", "bytes", "bpw", "band", "high_potential"]
    assert got.count() > 0


def test_scan_reads_only_what_it_needs(spark, data):
    plan = catalog.queries()["nearest_codeword"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>,label:int>" in plan
