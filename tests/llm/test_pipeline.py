"""The pipeline's stages, each against the rows it was given."""

import re

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")


def test_stages_take_effect(spark, documents, data):
    import corpus_pipeline

    from wordloom.llm import quality
    from wordloom.llm.common import stored

    docs, seen = documents, []
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, data), "stage")
        seen.append((name, docs, out))
        docs = out
    assert [n for n, _, _ in seen] == ["quality rules", "exact dedup", "near dedup", "personal data", "packing"]
    for _, before, after in seen[:-1]:
        assert after.columns == before.columns and after.schema == before.schema
    rules, exact, near, private, packed = seen
    kept = {r[0] for r in quality.judged(documents).filter("kept").select("wl_row.doc_id").collect()}
    assert {r.doc_id for r in rules[2].collect()} == kept
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    texts = [normal(r.text) for r in exact[2].collect()]
    assert len(texts) == len(set(texts)) and set(texts) == {normal(r.text) for r in exact[1].collect()}
    assert 0 < near[2].count() <= near[1].count()
    assert {r.doc_id for r in near[2].collect()} <= {r.doc_id for r in near[1].collect()}
    out = {r.doc_id: r for r in private[2].collect()}
    assert out.keys() == {r.doc_id for r in private[1].collect()} and all(r.n_chars == len(r.text) for r in out.values())
    rows = packed[2].collect()
    assert {r.doc_id for r in rows} == set(out)
    load = {}
    for r in rows:
        load.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in load.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0] + [n for _, n in own])[:-1].tolist() and sum(n for _, n in own) <= 2048


def test_run_and_names(spark, data):
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries()
    numbers = sorted(int(n[2:].split("_")[0]) for n in entry.queries() if re.match(r"op\d+_", n))
    assert numbers == list(range(1, 11))


def test_stages_on_odd_rows_and_none(spark, odd, nothing, data):
    import corpus_pipeline

    from wordloom.llm.common import stored

    for docs in (odd, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stored(stage(spark, docs, data), "stage")
            if name != "packing":
                assert out.columns == docs.columns, name
            assert out.count() <= docs.count() or name == "packing"
            if name == "personal data":
                assert out.count() == docs.count()
