"""Spatial predictors in four traversals of tiles, with the residuals, their decoding and the best geometry.

A tile is visited along a traversal; a word is predicted from neighbours that were visited before it and its residual
is the difference modulo 2**bits. All tiles of a batch advance together, a place of the traversal at a time; encoding
needs no order at all, since what is decoded there is the word itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.plans import dialect, relations
from wordloom.plans.dialect import long

#: Fixed order of predictors and traversals, which decides ties.
PREDICTORS = ("previous", "left", "up", "avg", "paeth")
TRAVERSALS = ("row", "row_serp", "col", "col_serp")
SIDE, BITS = 16, 7


def path(height: int, width: int, traversal: str) -> np.ndarray:
    """Places (y, x) in the order of a traversal."""
    y, x = np.divmod(np.arange(height * width), width)
    key = {
        "row": y * width + x,
        "row_serp": y * width + np.where(y % 2, width - 1 - x, x),
        "col": x * height + y,
        "col_serp": x * height + np.where(x % 2, height - 1 - y, y),
    }[traversal]
    order = np.argsort(key)
    return np.stack([y[order], x[order]], axis=1)


def _predicted(known: np.ndarray, y: int, x: int, previous: np.ndarray, predictor: str, traversal: str) -> np.ndarray:
    """Predictions at a place of all tiles (tiles x height x width), of which what was visited before is known."""
    left = known[:, y, x - 1] if x and not (traversal == "row_serp" and y % 2) else None
    up = known[:, y - 1, x] if y and not (traversal == "col_serp" and x % 2) else None
    if predictor == "previous":
        return previous
    if predictor == "left":
        return previous if left is None else left
    if predictor == "up":
        return previous if up is None else up
    if left is None or up is None:
        only = up if left is None else left
        return previous if only is None else only
    if predictor == "avg":
        return (left + up) // 2
    corner = known[:, y - 1, x - 1]
    guess = left + up - corner
    far = [np.abs(guess - left), np.abs(guess - up), np.abs(guess - corner)]
    return np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], up, corner))


def residuals(tiles: np.ndarray, predictor: str, traversal: str, bits: int = BITS) -> np.ndarray:
    out, previous = np.zeros_like(tiles), np.zeros(len(tiles), np.int64)
    for y, x in path(*tiles.shape[1:], traversal).tolist():
        out[:, y, x] = (tiles[:, y, x] - _predicted(tiles, y, x, previous, predictor, traversal)) & ((1 << bits) - 1)
        previous = tiles[:, y, x]
    return out


def reconstructed(found: np.ndarray, predictor: str, traversal: str, bits: int = BITS) -> np.ndarray:
    out, previous = np.zeros_like(found), np.zeros(len(found), np.int64)
    for y, x in path(*found.shape[1:], traversal).tolist():
        out[:, y, x] = (found[:, y, x] + _predicted(out, y, x, previous, predictor, traversal)) & ((1 << bits) - 1)
        previous = out[:, y, x]
    return out


def tiles_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tensor, tile, ws: full tiles of SIDE x SIDE words, row after row; a task holds SIDE rows of a tensor."""
    rows = relations.rows(spark, sf_dir).select("tensor", "r", F.posexplode(F.transform(F.sequence(F.lit(0), F.expr(f"size(ws) div {SIDE}") - 1), lambda i: F.slice("ws", i * SIDE + 1, F.lit(SIDE)))).alias("c", "ws"))
    tiles = rows.groupBy("tensor", F.expr(f"r div {SIDE}").alias("y"), "c").agg(F.array_sort(F.collect_list(F.struct("r", "ws"))).alias("rows"))
    return tiles.filter(F.size("rows") == SIDE).select("tensor", F.struct("y", "c").alias("tile"), F.flatten(F.transform("rows", lambda x: x.ws)).alias("ws"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tensor, y, c, pred, trav, zeros, distinct_res, residual_sum, differing for each tile and geometry."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            if not len(batch):
                continue
            words = np.stack([np.asarray(w, np.int64) for w in batch["ws"]]).reshape(-1, SIDE, SIDE) & ((1 << BITS) - 1)
            for t, traversal in enumerate(TRAVERSALS):
                for p, predictor in enumerate(PREDICTORS):
                    found = residuals(words, predictor, traversal)
                    flat = np.sort(found.reshape(len(words), -1), axis=1)
                    yield pd.DataFrame(
                        {
                            "tensor": batch["tensor"],
                            "y": batch["y"],
                            "c": batch["c"],
                            "pred": p,
                            "trav": t,
                            "zeros": (flat == 0).sum(axis=1),
                            "distinct_res": 1 + (np.diff(flat, axis=1) != 0).sum(axis=1),
                            "residual_sum": flat.sum(axis=1),
                            "differing": (reconstructed(found, predictor, traversal) != words).sum(axis=(1, 2)),
                        }
                    )

    tiles = tiles_of(spark, sf_dir).select("tensor", "tile.y", "tile.c", "ws")
    return tiles.mapInPandas(run, "tensor long, y long, c long, pred long, trav long, zeros long, distinct_res long, residual_sum long, differing long")


def spatial_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each tensor and geometry: words, zero residuals, their sum, and words that do not come back."""
    got = _scored(spark, sf_dir).groupBy("tensor", "pred", "trav")
    return got.agg((F.count("*") * SIDE * SIDE).alias("n_words"), F.sum("zeros").alias("zeros"), F.sum("residual_sum").alias("residual_sum"), F.sum("differing").alias("differing"))


def best_spatial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The geometry of each tile with the most zeros, then the fewest distinct residuals, then by the fixed order."""
    key = F.struct(-F.col("zeros"), "distinct_res", "pred", "trav")
    got = _scored(spark, sf_dir).groupBy("tensor", "y", "c").agg(F.min(key).alias("k"))
    return got.select("tensor", "y", F.col("c").alias("x"), F.col("k.pred").alias("pred"), F.col("k.trav").alias("trav"), (-F.col("k.col1")).alias("zeros"))


def _sql() -> str:
    """The residuals of all geometries in DuckDB."""
    d = dialect.DUCK
    order = {"row": "y * 16 + x", "row_serp": "y * 16 + CASE WHEN y % 2 = 0 THEN x ELSE 15 - x END", "col": "x * 16 + y", "col_serp": "x * 16 + CASE WHEN x % 2 = 0 THEN y ELSE 15 - y END"}
    parts = []
    for t, name in enumerate(TRAVERSALS):
        left = "CASE WHEN x > 0 AND y % 2 = 0 THEN l END" if name == "row_serp" else "CASE WHEN x > 0 THEN l END"
        up = "CASE WHEN y > 0 AND x % 2 = 0 THEN u END" if name == "col_serp" else "CASE WHEN y > 0 THEN u END"
        parts.append(f"SELECT tensor, ty, tx, {t} AS trav, v, {left} AS l, {up} AS u, CASE WHEN x > 0 AND y > 0 THEN q END AS q, coalesce(lag(v) OVER (PARTITION BY tensor, ty, tx ORDER BY {order[name]}), 0) AS p FROM g")
    guess = "(l + u - q)"
    paeth = f"CASE WHEN l IS NULL OR u IS NULL THEN coalesce(l, u, p) WHEN abs({guess} - l) <= abs({guess} - u) AND abs({guess} - l) <= abs({guess} - q) THEN l WHEN abs({guess} - u) <= abs({guess} - q) THEN u ELSE q END"
    rules = ["p", "coalesce(l, p)", "coalesce(u, p)", f"CASE WHEN l IS NULL OR u IS NULL THEN coalesce(l, u, p) ELSE {d.div('l + u', 2)} END", paeth]
    stacked = d.stacked("n", ["tensor", "ty", "tx", "trav"], [(long(i), f"(v - ({rule})) & 127") for i, rule in enumerate(rules)], ["pred", "res"])
    g = "h AS (SELECT tensor, max(r) + 1 AS h FROM words GROUP BY tensor), g AS (SELECT w.tensor, w.r // 16 AS ty, w.c // 16 AS tx, w.r % 16 AS y, w.c % 16 AS x, w.w & 127 AS v, w.left_w & 127 AS l, w.up_w & 127 AS u, w.nw_w & 127 AS q FROM words w JOIN h ON w.tensor = h.tensor WHERE w.r < h.h // 16 * 16)"
    return f"WITH {dialect.DUCK_RELATIONS['words']}, {g}, n AS ({' UNION ALL '.join(parts)}), s AS ({stacked})"


QUERIES = {f.__name__: f for f in (spatial_residuals, best_spatial)}
ORACLES = {
    "spatial_residuals": f"{_sql()} SELECT tensor, pred, {long('trav')} AS trav, {long('count(*)')} AS n_words, {long('sum(CASE WHEN res = 0 THEN 1 ELSE 0 END)')} AS zeros, {long('sum(res)')} AS residual_sum, {long('0')} AS differing FROM s GROUP BY tensor, pred, trav",
    "best_spatial": f"{_sql()}, t AS (SELECT tensor, ty, tx, pred, trav, sum(CASE WHEN res = 0 THEN 1 ELSE 0 END) AS zeros, count(DISTINCT res) AS k FROM s GROUP BY tensor, ty, tx, pred, trav) SELECT tensor, {long('ty')} AS y, {long('tx')} AS x, {long('arg_min(pred, (-zeros, k, pred, trav))')} AS pred, {long('arg_min(trav, (-zeros, k, pred, trav))')} AS trav, {long('max(zeros)')} AS zeros FROM t GROUP BY tensor, ty, tx",
}
