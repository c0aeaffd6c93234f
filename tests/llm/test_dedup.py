import hashlib
import re
import zlib

import numpy as np
import xxhash

from wordloom.llm import bloom_dedup, sharding, simhash
from wordloom.llm.graph import components


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_bloom_dedup_equals_brute_force(documents, odd):
    for df in (documents, odd):
        rows = [(r.doc_id, r.text or "") for r in df.collect()]
        groups = {}
        for i, t in rows:
            groups.setdefault(normal(t), []).append((-len(t), i is not None, i or 0, i))
        got = bloom_dedup.decisions(df).collect()
        want = []
        for i, t in rows:
            own = sorted(groups[normal(t)])
            want.append((i, own[0][3], len(own), i == own[0][3] and len(t) == -own[0][0], hashlib.sha256(normal(t).encode()).hexdigest()))
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
        kept = bloom_dedup.kept_rows(df)
        assert kept.columns == df.columns
        assert sorted(normal(r.text) for r in kept.collect()) == sorted(groups)


def test_bloom_dedup_of_nothing(nothing):
    assert bloom_dedup.decisions(nothing).count() == 0 and bloom_dedup.kept_rows(nothing).count() == 0


def test_a_full_filter_changes_nothing(documents, monkeypatch):
    want = sorted(map(tuple, bloom_dedup.decisions(documents).collect()))
    monkeypatch.setattr(bloom_dedup, "filter_cells", lambda rows: 64)
    monkeypatch.setattr(bloom_dedup, "PIECE", 64)
    assert sorted(map(tuple, bloom_dedup.decisions(documents).collect())) == want


def test_slices_of_the_filter_change_nothing(documents, monkeypatch):
    want = sorted(map(tuple, bloom_dedup.decisions(documents).collect()))
    kept = sorted(r.doc_id for r in bloom_dedup.kept_rows(documents).collect())
    monkeypatch.setattr(bloom_dedup, "MOST_CELLS", 1 << 9)
    monkeypatch.setattr(bloom_dedup, "PIECE", 1 << 7)
    assert sorted(map(tuple, bloom_dedup.decisions(documents).collect())) == want
    assert sorted(r.doc_id for r in bloom_dedup.kept_rows(documents).collect()) == kept


def test_kept_rows_may_hold_maps(spark):
    df = spark.sql("select id as doc_id, 'the same' as text, map('a', id) as m from range(6)")
    assert [tuple(r) for r in bloom_dedup.kept_rows(df).collect()] == [(0, "the same", {"a": 0})]


def test_hot_keys_are_dealt_out(spark, monkeypatch, documents):
    """Joins with every key over one row dealt over tasks give the same groups."""
    from wordloom.llm import common

    want = [sorted(map(repr, f(documents).collect())) for f in (bloom_dedup.decisions, simhash.near_groups)]
    near = sorted(r.doc_id for r in simhash.kept_rows(documents).collect())
    monkeypatch.setattr(common, "HEAVY", 1)
    assert [sorted(map(repr, f(documents).collect())) for f in (bloom_dedup.decisions, simhash.near_groups)] == want
    assert sorted(r.doc_id for r in simhash.kept_rows(documents).collect()) == near


def test_merge_trees_lose_nothing(spark, monkeypatch):
    from wordloom.llm import common

    monkeypatch.setattr(common, "FAN_IN", 3)
    rows = [(k, p, bytes([k + 1, p])) for k in range(4) for p in range(11) if (k + p) % 3]
    df = spark.createDataFrame(rows, "piece long, part long, value binary")
    for parts in (1, 3, 11):  # right even if the number of parts was too low
        got = {r.piece: bytes(r.value) for r in common.merged(df, "piece", "part", ["value"], lambda own: (bytes(x & 255 for x in map(sum, zip(*(v for (v,) in own), strict=True))),), parts).collect()}
        assert got == {k: bytes(x & 255 for x in map(sum, zip(*(v for key, _, v in rows if key == k), strict=True))) for k in range(4)}


def slow_fingerprint(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def by_all_pairs(prints, radius, ids):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= radius):
            a, b = find(i), find(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [low.get(find(i)) for i in range(len(prints))]


def test_simhash_equals_all_pairs(documents, odd, nothing):
    for df in (documents, odd):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        prints = [slow_fingerprint(t, 4) for _, t in rows]
        want = by_all_pairs(np.array(prints, np.uint64), 4, [i for i, _ in rows])
        got = simhash.near_groups(df, 4, 4).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, format(p, "016x"), c)) for (i, _), p, c in zip(rows, prints, want, strict=True))
    assert simhash.near_groups(nothing, 4, 4).count() == 0


def test_masks_cover_every_pair():
    rng = np.random.default_rng(0)
    own = np.array(simhash.masks(4), np.int64).view(np.uint64)
    for _ in range(3000):
        apart = np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)))
        assert (own & apart == 0).any()


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """A dense cloud of fingerprints, with buckets too large to compare."""
    rng = np.random.default_rng(3)
    prints = {int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for c in rng.integers(0, 1 << 62, 6) for _ in range(60)}
    prints = np.array(sorted(prints), np.uint64)
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "node long").selectExpr("node", "array(node) fps", "cast(array() as array<long>) sketch").cache()
    want = by_all_pairs(prints, 4, prints.tolist())
    for small in (4096, 8):
        monkeypatch.setattr(simhash, "SMALL", small)
        found = {r.node: r.root for r in components(simhash.links(df, 4)).collect()}
        groups, same = {}, {}
        for p, w in zip(prints.view(np.int64).tolist(), want, strict=True):
            groups.setdefault(found.get(p, p), set()).add(p)
            same.setdefault(w, set()).add(p)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, same.values()))


def test_large_buckets_are_judged_by_the_sketch(spark, monkeypatch):
    """Texts of the same long words in other orders share all finders, but not their shingles."""
    rng = np.random.default_rng(4)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), 8)) for _ in range(60)]
    rows = []
    for i in range(30):
        words = list(rng.permutation(vocabulary))
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words, "of"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for small in (4096, 8):
        monkeypatch.setattr(simhash, "SMALL", small)
        assert sorted(r.doc_id for r in simhash.kept_rows(df).collect()) == [2 * i for i in range(30)]


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 180)] + [(500, 500 + i) for i in range(1, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 181)) and all(got[i] == 500 for i in range(500, 700))


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_near_copies_go_and_others_stay(spark, odd, nothing):
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 10))) for _ in range(4000)]
    rows, number = [], 0
    for g in range(40):
        words = list(rng.choice(vocabulary, 300))
        rows.append((number, " ".join(words), "en", g))
        number += 1
        for _ in range(3):
            copy = list(words)
            for at in rng.choice(300, 2, replace=False):
                copy[at] = str(rng.choice(vocabulary))
            rows.append((number, " ".join(copy), "en", g))
            number += 1
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, grp long")
    kept = simhash.kept_rows(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [4 * g for g in range(40)]
    assert simhash.kept_rows(nothing).count() == 0
    left = [r.doc_id for r in simhash.kept_rows(odd).collect()]
    assert 1 in left and 2 not in left and None in left and 6 in left and 7 in left


def test_block_edits_and_short_words_are_candidates():
    """Copies with a passage added or removed, at a similarity of 0.8 to 0.85, of long and of short words."""
    rng = np.random.default_rng(6)
    for sizes in ((3, 10), (1, 5)):
        vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(*sizes))) for _ in range(4000)]
        found = total = 0
        for g in range(300):
            words = list(rng.choice(vocabulary, 300))
            copy = words + list(rng.choice(vocabulary, 60)) if g % 2 else words[:120] + words[170:]
            a, b = " ".join(words), " ".join(copy)
            if not 0.8 <= len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) <= 0.85:
                continue
            x, y = simhash.signature(a)[0], simhash.signature(b)[0]
            near = np.bitwise_count(x ^ y)
            found += bool((near[: simhash.FINDERS] <= 4).any() or (near[simhash.FINDERS :] == 0).any())
            total += 1
        assert total > 200 and found >= 0.9 * total


def test_recall_of_near_copies_in_every_band(spark):
    """Copies with scattered words changed, or with a passage added or removed: of the pairs of each band of similarity
    from 0.8 up at least nine in ten are found, and of those below 0.8 none is linked."""
    rng = np.random.default_rng(7)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 10))) for _ in range(6000)]
    rows, pairs = [], []
    for g in range(900):
        words = list(rng.choice(vocabulary, rng.integers(60, 500)))
        copy, share = list(words), rng.uniform(0.0, 0.25)
        if g % 3 == 0:
            for at in rng.choice(len(words), max(1, int(len(words) * share / 8)), replace=False):
                copy[at] = str(rng.choice(vocabulary))
        elif g % 3 == 1:
            copy += list(rng.choice(vocabulary, int(len(words) * share)))
        else:
            at = int(rng.integers(0, len(words) // 2))
            copy = words[:at] + words[at + int(len(words) * share) :]
        a, b = " ".join(words), " ".join(copy)
        rows += [(2 * g, a), (2 * g + 1, b)]
        pairs.append(len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.kept_rows(df).collect()}
    assert all(2 * g in kept for g in range(900))
    for low in (0.8, 0.85, 0.9, 0.95):
        own = [g for g, s in enumerate(pairs) if low <= s < low + 0.05 or low == 0.95 and s == 1]
        assert len(own) > 60 and sum(2 * g + 1 not in kept for g in own) >= 0.9 * len(own), low
    assert all(2 * g + 1 in kept for g, s in enumerate(pairs) if s < 0.8)


def test_short_different_texts_stay(spark):
    df = spark.createDataFrame([(i, f"yes no {i}") for i in range(300)], "doc_id long, text string")
    assert simhash.kept_rows(df).count() == 300


def check_shards(df, shards):
    got = sharding.assigned(df, shards).collect()
    rows = sorted((repr(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in df.collect())
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in got) == rows
    slots = {}
    load = [0] * shards
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load) - min(load) <= 2 * max(r.size for r in got)
    return got


def test_shards_are_even(spark, documents, odd, nothing, tmp_path):
    got = check_shards(documents, 8)
    check_shards(odd, 3)
    assert sharding.assigned(nothing, 8).count() == 0
    texts = {}
    for r in got:
        texts.setdefault(r.text_crc32, set()).add(r.shard)
    assert sum(len(s) > 1 for s in texts.values()) <= 7  # only where a cut falls
    sharding.write_shards(documents, 8, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.doc_id, r.wl_shard) for r in back.collect()} == {(r.doc_id, r.shard) for r in got}


def test_rows_alike_are_written_each(spark, odd, tmp_path):
    sharding.write_shards(odd, 3, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(repr, back.select(*odd.columns).collect())) == sorted(map(repr, odd.collect()))


def test_a_hot_text_is_split(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "case when id % 3 = 0 then repeat('hot ', 200) else repeat(cast(id as string), 40) end as text")
    got = check_shards(df, 8)
    hot = {r.shard for r in got if r.doc_id % 3 == 0}
    assert len(hot) > 1
