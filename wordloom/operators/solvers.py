"""Solvers that are sequential by nature: what is large is summed by Spark, what remains is small or runs row by row.

Allocation, codebooks and factorisations work on tables bounded by a parameter (units, levels, 64 x 64 moments); error
feedback and trellis quantisers run over independent rows in Arrow batches.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators import stats  # noqa: F401  defines `phrases`
from wordloom.plans import dialect, relations

#: Candidate widths of a unit of 16 rows, bits of a group's scale and zero point, bits of the map for a row.
WIDTHS, GROUP, GROUP_BITS, MAP_BITS = (3, 4, 5, 6, 8), 64, 24, 8


def error_scale(bits: int) -> float:
    return 0.0 if bits >= 16 else 1.0 / (2**bits - 1) ** 2


def allocate(importance: list[float], weights: list[int], rows: list[int], budget_bits: float) -> list[int]:
    """Widths of units: upgrade where it saves the most error a bit, and pass over upgrades that exceed the budget.
    Ties go to the more important unit, then to the first."""

    def cost(i: int, bits: int) -> int:
        return weights[i] * bits + -(-weights[i] // GROUP) * GROUP_BITS

    level = [0] * len(weights)
    spent = sum(cost(i, WIDTHS[0]) for i in range(len(weights))) + MAP_BITS * sum(rows)
    waiting: list[tuple] = []

    def offer(i: int) -> None:
        if level[i] + 1 < len(WIDTHS):
            now, then = WIDTHS[level[i]], WIDTHS[level[i] + 1]
            more = cost(i, then) - cost(i, now)
            heapq.heappush(waiting, (-importance[i] * (error_scale(now) - error_scale(then)) / more, -importance[i], i, more))

    for i in range(len(weights)):
        offer(i)
    while waiting:
        _, _, i, more = heapq.heappop(waiting)
        if spent + more <= budget_bits:
            spent += more
            level[i] += 1
            offer(i)
    return [WIDTHS[k] for k in level]


def width_allocation(spark: SparkSession, sf_dir: str, budget: float = 4.75) -> DataFrame:
    """tensor, unit, bits: units of 16 rows by their norm; one row a unit reaches the driver."""
    rows = relations.rows(spark, sf_dir).select("tensor", "r", F.aggregate("xs", F.lit(0.0), lambda a, x: a + x * x).alias("q"), F.size("xs").alias("n"))
    units = rows.groupBy("tensor", F.expr("r div 16").alias("unit")).agg(F.sqrt(F.avg("q")).alias("norm"), F.sum("n").alias("n"), F.count("*").alias("k")).orderBy("tensor", "unit").collect()
    total = sum(u.n for u in units)
    widths = allocate([float(round(u.norm, 9)) for u in units], [int(u.n) for u in units], [int(u.k) for u in units], budget * total)
    return spark.createDataFrame([(u.tensor, u.unit, int(w), int(u.n)) for u, w in zip(units, widths, strict=True)], "tensor long, unit long, bits long, n_words long")


def lloyd_levels(spark: SparkSession, sf_dir: str, levels: int = 8, rounds: int = 12) -> DataFrame:
    """A one-dimensional codebook of all values: starts at quantiles; each round is one aggregate. An empty level stays."""
    values = relations.words(spark, sf_dir).select("x")
    centres = values.select(F.percentile("x", F.array(*[F.lit((i + 0.5) / levels) for i in range(levels)])).alias("p")).first().p
    for _ in range(rounds):
        cuts = [(a + b) / 2 for a, b in zip(centres[:-1], centres[1:], strict=True)]
        code = sum((F.when(F.col("x") > c, 1).otherwise(0) for c in cuts), F.lit(0))
        means = {r.code: r.m for r in values.groupBy(code.alias("code")).agg(F.avg("x").alias("m")).collect()}
        centres = [means.get(i, c) for i, c in enumerate(centres)]
    cuts = [(a + b) / 2 for a, b in zip(centres[:-1], centres[1:], strict=True)]
    code = sum((F.when(F.col("x") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    table = F.array(*[F.lit(float(c)) for c in centres])
    return values.groupBy(code.cast("long").alias("level")).agg(F.round(F.avg(F.pow(F.col("x") - F.get(table, code), F.lit(2))), 9).alias("mse"), F.count("*").alias("n"))


def second_moments(spark: SparkSession, sf_dir: str) -> np.ndarray:
    """64 x 64: sums of products of columns over all rows, from partial sums of batches."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = 0.0, 0
        for batch in it:
            x = np.stack(batch["xs"].to_numpy())
            total, n = total + x.T @ x, n + len(x)
        if n:
            yield pd.DataFrame({"i": range(len(total)), "h": list(total), "n": n})

    parts = relations.rows(spark, sf_dir).select("xs").mapInPandas(run, "i int, h array<double>, n long")
    cells = parts.select("i", "n", F.posexplode("h").alias("j", "h")).groupBy("i", "j").agg(F.sum("h").alias("h"), F.sum("n").alias("n")).collect()
    size = max(r.i for r in cells) + 1
    out = np.zeros((size, size))
    for r in cells:
        out[r.i, r.j] = r.h / r.n
    return out


def feedback_rows(rows: np.ndarray, moments: np.ndarray, bits: int, damp: float = 0.01) -> np.ndarray:
    """Round columns in turn; each error is spread over the columns to come by the inverse moments' Cholesky factor."""
    size = len(moments)
    inverse = np.linalg.inv(moments + damp * np.mean(np.diag(moments)) * np.eye(size))
    upper = np.linalg.cholesky(inverse).T
    top = 2 ** (bits - 1) - 1
    scale = np.maximum(np.abs(rows).max(axis=1, keepdims=True) / top, 1e-12)
    work, out = rows.copy(), np.empty_like(rows)
    for c in range(size):
        out[:, c] = np.clip(np.rint(work[:, c] / scale[:, 0]), -top - 1, top) * scale[:, 0]
        error = (work[:, c] - out[:, c]) / upper[c, c]
        work[:, c + 1 :] -= error[:, None] * upper[c, c + 1 :]
    return out


def nearest_rows(rows: np.ndarray, bits: int) -> np.ndarray:
    top = 2 ** (bits - 1) - 1
    scale = np.maximum(np.abs(rows).max(axis=1, keepdims=True) / top, 1e-12)
    return np.clip(np.rint(rows / scale), -top - 1, top) * scale


def trellis_rows(rows: np.ndarray, levels: np.ndarray, states: int = 8) -> np.ndarray:
    """Viterbi over a shift-register trellis: a state reaches two others, and each edge allows a quarter of the levels."""
    n, count = rows.shape
    scale = np.maximum(rows.std(axis=1), 1e-12)[:, None]
    x = rows / scale
    subsets = [levels[k::4] for k in range(4)]
    score = np.where(np.arange(states) == 0, 0.0, np.inf)[None, :].repeat(n, 0)
    before, value = np.zeros((count, n, states), np.int8), np.zeros((count, n, states))
    for t in range(count):
        nearest = np.stack([s[np.abs(x[:, t, None] - s).argmin(axis=1)] for s in subsets], axis=1)
        cost = (x[:, t, None] - nearest) ** 2
        new = np.full((n, states), np.inf)
        for s in range(states):
            for bit in (0, 1):
                to, subset = (2 * s + bit) % states, (2 * (s % 2) + bit) ^ (s >> 2 & 1)
                total = score[:, s] + cost[:, subset]
                better = total < new[:, to]
                new[better, to], before[t, better, to], value[t, better, to] = total[better], s, nearest[better, subset]
        score = new
    state, out, row = score.argmin(axis=1), np.empty_like(x), np.arange(n)
    for t in range(count - 1, -1, -1):
        out[:, t] = value[t, row, state]
        state = before[t, row, state]
    return out * scale


def _by_rows(spark: SparkSession, sf_dir: str, method, moments: np.ndarray | None) -> DataFrame:
    known = spark.sparkContext.broadcast(moments)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            if not len(batch):
                continue
            x = np.stack(batch["xs"].to_numpy())
            e = x - method(x, known.value)
            weighted = np.einsum("ri,ij,rj->r", e, known.value, e) if known.value is not None else (e**2).sum(axis=1)
            yield pd.DataFrame({"tensor": batch["tensor"], "signal": (x**2).sum(axis=1), "noise": (e**2).sum(axis=1), "output_noise": weighted})

    rows = relations.rows(spark, sf_dir).select("tensor", "xs").mapInPandas(run, "tensor long, signal double, noise double, output_noise double")
    return rows.groupBy("tensor").agg(F.round(10 * F.log10(F.sum("signal") / F.sum("noise")), 4).alias("sqnr"), F.round(F.sum("output_noise"), 6).alias("output_noise"))


def feedback_quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three bits with error feedback, judged by output noise under the second moments."""
    return _by_rows(spark, sf_dir, lambda x, h: feedback_rows(x, h, 3), second_moments(spark, sf_dir))


def nearest_quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three bits to nearest, for comparison."""
    return _by_rows(spark, sf_dir, lambda x, h: nearest_rows(x, 3), second_moments(spark, sf_dir))


def trellis_quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two bits a value by a trellis over eight levels."""
    levels = np.array([-2.2, -1.35, -0.8, -0.3, 0.3, 0.8, 1.35, 2.2])
    return _by_rows(spark, sf_dir, lambda x, h: trellis_rows(x, levels), None)


def low_rank_correction(spark: SparkSession, sf_dir: str, rank: int = 8) -> DataFrame:
    """Share of the quantiser's weighted error that the best factors of each rank would mend."""
    moments = second_moments(spark, sf_dir)
    values, vectors = np.linalg.eigh(moments)
    root = (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T
    known = spark.sparkContext.broadcast(root)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            if len(batch):
                x = np.stack(batch["xs"].to_numpy())
                e = (x - nearest_rows(x, 3)) @ known.value
                g = e.T @ e
                yield pd.DataFrame({"i": np.repeat(range(len(g)), len(g)), "j": np.tile(range(len(g)), len(g)), "v": g.reshape(-1)})

    cells = relations.rows(spark, sf_dir).select("xs").mapInPandas(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # 64 x 64
    g = np.zeros_like(moments)
    for r in cells:
        g[r.i, r.j] = r.v
    energy = np.linalg.eigvalsh(g)[::-1]
    share = np.cumsum(energy) / energy.sum()
    return spark.createDataFrame([(k + 1, round(float(share[k]), 6)) for k in range(rank)], "rank long, mended double")


def phrase_replaced(symbols: list[int], phrases: list[tuple[int, ...]]) -> list[int]:
    """Greedy from the left: the first phrase that fits takes the place of its symbols, as a code above 255."""
    out, i = [], 0
    while i < len(symbols):
        for k, p in enumerate(phrases):
            if tuple(symbols[i : i + len(p)]) == p:
                out.append(256 + k)
                i += len(p)
                break
        else:
            out.append(symbols[i])
            i += 1
    return out


def phrase_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of exponents under the 16 commonest phrases of four: symbols before and after, and what differs on the way
    back."""
    found = [(int(r.e0), int(r.e1), int(r.e2), int(r.e3)) for r in dialect.run("phrases", spark, sf_dir).collect()]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            rows = []
            for tensor, words in zip(batch["tensor"], batch["ws"], strict=True):
                e = (np.asarray(words, np.int64) >> 7 & 255).tolist()
                short = phrase_replaced(e, found)
                back = [s for x in short for s in (found[x - 256] if x > 255 else (x,))]
                rows.append((tensor, len(e), len(short), int(back != e)))
            yield pd.DataFrame(rows, columns=["tensor", "symbols", "codes", "differing"])

    rows = relations.rows(spark, sf_dir).select("tensor", "ws").mapInPandas(run, "tensor long, symbols long, codes long, differing long")
    return rows.groupBy("tensor").agg(F.sum("symbols").alias("symbols"), F.sum("codes").alias("codes"), F.sum("differing").alias("differing"))


QUERIES = {f.__name__: f for f in (width_allocation, lloyd_levels, feedback_quantised, nearest_quantised, trellis_quantised, low_rank_correction, phrase_grammar)}
#: Three bits to nearest in SQL; the output noise is the sum over pairs of columns of their second moment and their errors.
ORACLES = {
    "nearest_quantised": f"""WITH {dialect.DUCK_RELATIONS['words']}, a AS (SELECT vec_id, greatest(max(abs(x)) / 3, 1e-12) AS s FROM words GROUP BY vec_id),
e AS (SELECT w.tensor, w.vec_id, w.c, w.x, w.x - greatest(least(round_even(w.x / a.s, 0), 3), -4) * a.s AS e FROM words w JOIN a ON w.vec_id = a.vec_id),
h AS (SELECT p.c AS i, q.c AS j, sum(p.x * q.x) / (SELECT count(*) FROM a) AS h FROM e p JOIN e q ON p.vec_id = q.vec_id GROUP BY p.c, q.c),
k AS (SELECT p.tensor, p.c AS i, q.c AS j, sum(p.e * q.e) AS k FROM e p JOIN e q ON p.vec_id = q.vec_id GROUP BY p.tensor, p.c, q.c),
o AS (SELECT k.tensor, sum(k.k * h.h) AS noise FROM k JOIN h ON k.i = h.i AND k.j = h.j GROUP BY k.tensor),
s AS (SELECT tensor, 10 * log10(sum(x * x) / sum(e * e)) AS sqnr FROM e GROUP BY tensor)
SELECT s.tensor, round(s.sqnr, 4) AS sqnr, round(o.noise, 6) AS output_noise FROM s JOIN o ON s.tensor = o.tensor"""
}
