import itertools

import numpy as np

from wordloom.operators import solvers


def test_allocation_keeps_the_budget_and_prefers_the_important():
    widths = solvers.allocate([4.0, 1.0, 1.0], [1024] * 3, [16] * 3, 3 * 1024 * 5.0)
    spent = sum(1024 * w + 16 * solvers.GROUP_BITS for w in widths) + 3 * 16 * solvers.MAP_BITS
    assert spent <= 3 * 1024 * 5.0 and widths[0] == max(widths) and widths[1] >= widths[2]


def test_feedback_lowers_output_noise():
    rng = np.random.default_rng(0)
    mix = rng.normal(size=(16, 16))
    x, w = rng.normal(size=(500, 16)) @ mix, rng.normal(size=(40, 16))
    h = x.T @ x / len(x)
    noise = lambda q: np.einsum("ri,ij,rj->", w - q, h, w - q)
    assert noise(solvers.feedback_rows(w, h, 3)) < 0.7 * noise(solvers.nearest_rows(w, 3))


def test_trellis_is_the_best_path():
    levels = np.array([-2.2, -1.35, -0.8, -0.3, 0.3, 0.8, 1.35, 2.2])
    x = np.random.default_rng(2).normal(size=(3, 7))
    got = solvers.trellis_rows(x, levels)
    for row, out in zip(x, got, strict=True):
        scale, best = row.std(), np.inf
        for bits in itertools.product((0, 1), repeat=len(row)):
            state, cost = 0, 0.0
            for v, bit in zip(row / scale, bits, strict=True):
                subset = (2 * (state % 2) + bit) ^ (state >> 2 & 1)
                cost += ((v - levels[subset::4]) ** 2).min()
                state = (2 * state + bit) % 8
            best = min(best, cost)
        assert abs(((row - out) ** 2).sum() / scale**2 - best) < 1e-9


def test_solvers_run(spark, data):
    for name, query in solvers.QUERIES.items():
        assert query(spark, data).count() > 0, name
    grammar = solvers.phrase_grammar(spark, data).collect()
    assert all(r.differing == 0 and r.codes <= r.symbols for r in grammar)
    better = {r.tensor: r.output_noise for r in solvers.feedback_quantised(spark, data).collect()}
    plain = {r.tensor: r.output_noise for r in solvers.nearest_quantised(spark, data).collect()}
    assert sum(better.values()) < sum(plain.values())
