import collections
import math
import zlib

import numpy as np

from wordloom.llm import maxent


def base(rows):
    split = [((t or "").encode().lower().split() + [b"\n"], zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1) for i, t in rows]
    counts = collections.Counter(w for words, held in split if not held for w in words)
    total = sum(counts.values())
    below = total + 0.5 * (len(counts) + 1)
    return [(held, len(words), sum(counts[w] > 0 for w in words), total, sum(math.log10((counts[w] + 0.5) / below) for w in words)) for words, held in split]


def test_base_equals_brute_force_and_the_model_is_better(spark, documents, odd):
    for df in (documents, odd):
        rows = sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
        got = sorted(maxent.scored(df).collect(), key=lambda r: (repr((r.doc_id,)), r.n_tokens))
        want = sorted(zip([i for i, _ in rows], base(rows), strict=True), key=lambda x: (repr((x[0],)), x[1][1]))
        for r, (i, w) in zip(got, want, strict=True):
            assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i, *w[:4])
            assert abs(r.base_score - w[4]) < 1e-6 * max(1, abs(w[4])) and r.score <= 0 and math.isfinite(r.score)
        if df is documents:
            held = [r for r in got if r.held_out]
            assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_rare_words_meet_their_counts(documents, monkeypatch):
    want = sorted((r.doc_id, r.n_known, round(r.base_score, 6)) for r in maxent.scored(documents).collect())
    monkeypatch.setattr(maxent, "HEAD", 500)
    assert sorted((r.doc_id, r.n_known, round(r.base_score, 6)) for r in maxent.scored(documents).collect()) == want


def test_nothing(nothing):
    assert maxent.scored(nothing).count() == 0


def test_classes_are_a_distribution():
    rng = np.random.default_rng(0)
    model = maxent.Model(np.arange(1, 32, dtype=np.uint64) << np.uint64(10), rng.integers(31, 64, maxent.SUFFIXES))
    model.weights = rng.normal(size=model.weights.shape).astype(np.float32)
    keys = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    p = model.probabilities(maxent.features(keys, np.array([50, 200])))
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5)
    y = rng.integers(0, 64, 200)
    assert np.allclose(model.of_class(maxent.features(keys, np.array([50, 200])), y), p[np.arange(200), y], rtol=1e-5)


def test_steps_follow_the_gradient():
    """A step's change of each weight is the gradient of the loss over its root of squares: against differences."""
    rng = np.random.default_rng(1)
    model = maxent.Model(np.zeros(0, np.uint64), rng.integers(0, 64, maxent.SUFFIXES))
    model.weights = rng.normal(size=model.weights.shape).astype(np.float32) * 0.1
    keys = rng.integers(0, 50, 64, dtype=np.uint64) << np.uint64(40)
    feats, y = maxent.features(keys, np.array([64])), rng.integers(0, 64, 64)
    before = model.weights.astype(np.float64)

    def loss_of(weights):
        rows = weights.reshape(3, -1, maxent.SIDE)

        def logs(row):
            z = sum(rows[k][feats[k] * maxent.ROWS + row] for k in range(3)) + model.bias[row]
            return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

        each, g = np.arange(64), y // maxent.SIDE
        return -(logs(0)[each, g] + logs(g + 1)[each, y % maxent.SIDE]).sum()

    squares = np.full(model.weights.shape, maxent.CALM, np.float32)
    assert abs(model.step(feats, y, squares) - loss_of(before)) < 1e-3
    moved = np.argwhere(model.weights != before.astype(np.float32))
    for k, b, i in moved[rng.choice(len(moved), 30, replace=False)]:
        up, down = before.copy(), before.copy()
        up[k, b, i] += 1e-5
        down[k, b, i] -= 1e-5
        gradient = (loss_of(up) - loss_of(down)) / 2e-5
        want = maxent.STEP * gradient / np.sqrt(maxent.CALM + gradient**2)
        assert abs(float(before[k, b, i]) - float(model.weights[k, b, i]) - want) < 2e-3
    for _ in range(30):
        last = model.step(feats, y, squares)
    assert last < 0.3 * loss_of(before)


def test_training_settles_and_scores_are_probabilities(spark, documents):
    """Passes end when the loss settles, held-out texts gain over the base, and a history's words sum to one."""
    rows = maxent.tokens(documents)
    train = rows.filter("not held_out")
    table = maxent.counts(train)
    n_all = table.groupBy().sum("n").first()[0]
    model, in_class, losses = maxent.fitted(train, table, maxent._head(table), n_all)
    assert 1 <= len(losses) <= maxent.PASSES and losses[-1][3] < 0.95 * losses[0][0]
    assert len(losses) == maxent.PASSES or losses[-1][2] - losses[-1][3] <= maxent.TOLERANCE * losses[-1][2]
    words = table.toPandas()
    keys, n = words["key"].to_numpy(np.int64).view(np.uint64), words["n"].to_numpy()
    y = model.classes(keys)
    history = maxent.features(keys[:3], np.array([3]), model.buckets)
    for i in range(3):
        p = model.probabilities([f[i : i + 1] for f in history])[0]
        own = np.where(y < len(model.singles), p[y], p[y] * (n + 0.5) / 10.0 ** in_class[y])
        # the rest of each class is its half count for unknown words
        unknown = sum(p[c] * 0.5 / 10.0 ** in_class[c] for c in range(len(model.singles), maxent.CLASSES))
        assert abs(own.sum() + unknown - 1) < 1e-3
