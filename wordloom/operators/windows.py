"""Residuals against neighbours and their inverses, predictors, runs, joins of tensors, rankings and tiers."""

from __future__ import annotations

from wordloom.operators.fields import TRAVERSALS, fields, keep_k, traversal
from wordloom.plans.dialect import definition, long, six

RASTER = "PARTITION BY tensor ORDER BY r, c"


@definition("words")
def prev_value_roundtrip(d):
    """Row by row: the raster neighbour is XORed in, prefix XOR gives it back; the base of a row is the word before it."""
    x = f"x AS (SELECT tensor, r, c, w, {d.xor('w', 'coalesce(prev_w, 0)')} AS res, CASE WHEN c = 0 THEN coalesce(prev_w, 0) ELSE 0 END AS base FROM words)"
    y = f"y AS (SELECT tensor, r, c, w, res, {d.xor_prefix(d.xor('res', 'base'), 'PARTITION BY tensor, r ORDER BY c')} AS back FROM x)"
    return f"{x}, {y}", f"SELECT tensor, {long('count(*)')} AS n_words, {long('sum(CASE WHEN back <> w THEN 1 ELSE 0 END)')} AS differing, {long('sum(CASE WHEN res = 0 THEN 1 ELSE 0 END)')} AS zeros, {long('sum(res)')} AS residual_sum FROM y GROUP BY tensor"


@definition("words")
def prev_row_roundtrip(d):
    x = f"x AS (SELECT tensor, r, c, w, {d.xor('w', 'coalesce(up_w, 0)')} AS res FROM words)"
    y = f"y AS (SELECT tensor, w, res, {d.xor_prefix('res', 'PARTITION BY tensor, c ORDER BY r')} AS back FROM x)"
    ones = d.pop("res")
    return f"{x}, {y}", f"SELECT tensor, {long('count(*)')} AS n_words, {long('sum(CASE WHEN back <> w THEN 1 ELSE 0 END)')} AS differing, {six(f'avg({ones})')} AS mean_ones FROM y GROUP BY tensor"


def counted(source, keys, symbol):
    """Counts of a symbol within groups, and the most frequent (the smallest of equals)."""
    return f"SELECT {keys}, {symbol} AS sym, count(*) AS n FROM {source} GROUP BY {keys}, {symbol}"


@definition("words")
def constant_residuals(d):
    """Exponents of 256-word tiles against the most frequent of the tile."""
    t = f"t AS (SELECT tensor, {d.div('r', 4)} AS tile, {d.shr('w', 7)} & 255 AS e FROM words), k AS ({counted('t', 'tensor, tile', 'e')}), m AS (SELECT tensor, tile, {d.argmin('sym', '-n', 'sym')} AS mode FROM k GROUP BY tensor, tile)"
    ones = d.pop(d.xor("e", "m.mode"))
    return t, f"SELECT t.tensor, t.tile, {long('max(m.mode)')} AS mode, {long(f'sum({ones})')} AS ones FROM t JOIN m ON t.tensor = m.tensor AND t.tile = m.tile GROUP BY t.tensor, t.tile"


@definition("words")
def mod_delta_roundtrip(d):
    x = f"x AS (SELECT tensor, r, c, {d.shr('w', 7)} & 255 AS e, {d.shr('left_w', 7)} & 255 AS p FROM words), y AS (SELECT tensor, r, c, e, (e - coalesce(p, 0)) & 255 AS dlt FROM x)"
    z = "z AS (SELECT tensor, e, dlt, sum(dlt) OVER (PARTITION BY tensor, r ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS acc FROM y)"
    back = f"({long('acc')} & 255)"
    return f"{x}, {z}", f"SELECT tensor, {long('count(*)')} AS n_words, {long(f'sum(CASE WHEN {back} <> e THEN 1 ELSE 0 END)')} AS differing, {long('sum(dlt)')} AS delta_sum FROM z GROUP BY tensor"


def neighbours(d, bits):
    """Neighbours within 16 x 16 tiles, of the low bits; null outside the tile."""
    v = lambda x: f"({x} & {(1 << bits) - 1})"
    return f"g AS (SELECT tensor, {d.div('r', 16)} * 4 + {d.div('c', 16)} AS tile, r % 16 AS y, c % 16 AS x, {v('w')} AS v, CASE WHEN c % 16 > 0 THEN {v('left_w')} END AS l, CASE WHEN r % 16 > 0 THEN {v('up_w')} END AS u, CASE WHEN c % 16 > 0 AND r % 16 > 0 THEN {v('nw_w')} END AS q FROM words)"


def paeth():
    est = "(l + u - coalesce(q, 0))"
    return f"CASE WHEN l IS NULL AND u IS NULL THEN 0 WHEN l IS NULL THEN u WHEN u IS NULL THEN l WHEN abs({est} - l) <= abs({est} - u) AND abs({est} - l) <= abs({est} - coalesce(q, 0)) THEN l WHEN abs({est} - u) <= abs({est} - coalesce(q, 0)) THEN u ELSE coalesce(q, 0) END"


def predictors(d):
    return {"left": "coalesce(l, u, 0)", "up": "coalesce(u, l, 0)", "avg": f"CASE WHEN l IS NULL OR u IS NULL THEN coalesce(l, u, 0) ELSE {d.div('l + u', 2)} END", "paeth": paeth()}


@definition("words")
def paeth_residuals(d):
    res = d.xor("v", f"({paeth()})")
    return f"{neighbours(d, 7)}, p AS (SELECT tensor, {res} AS res FROM g)", f"SELECT {long('res')} AS res, {long('count(*)')} AS n FROM p GROUP BY res"


@definition("words")
def best_geometry(d):
    parts = d.stacked("g", ["tensor", "tile"], [(long(i), long(d.xor("v", f"({p})"))) for i, p in enumerate(predictors(d).values())], ["pred", "res"])
    s = "s AS (SELECT tensor, tile, pred, sum(CASE WHEN res = 0 THEN 1 ELSE 0 END) AS zeros, count(DISTINCT res) AS distinct_res FROM a GROUP BY tensor, tile, pred)"
    return f"{neighbours(d, 5)}, a AS ({parts}), {s}", f"SELECT tensor, tile, {long(d.argmin('pred', '-zeros', 'distinct_res', 'pred'))} AS pred, {long('max(zeros)')} AS zeros FROM s GROUP BY tensor, tile"


@definition("words")
def run_lengths(d):
    x = f"x AS (SELECT tensor, r, c, {d.shr('w', 7)} & 255 AS e, {d.shr('left_w', 7)} & 255 AS p FROM words)"
    y = "y AS (SELECT tensor, r, c, e, sum(CASE WHEN e = p THEN 0 ELSE 1 END) OVER (PARTITION BY tensor, r ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM x)"
    z = "z AS (SELECT tensor, r, island, e, count(*) AS len FROM y GROUP BY tensor, r, island, e)"
    return f"{x}, {y}, {z}", f"SELECT {long('len')} AS len, {long('count(*)')} AS runs, {long('sum(len)')} AS n_words, {long('sum(e)')} AS exponent_sum FROM z GROUP BY len"


@definition("words")
def traversal_previous(d):
    """XOR with the word before in each traversal of 8 x 8 tiles."""
    parts = d.stacked("g", ["tensor", "t", "w"], [(f"'{n}'", long(traversal(n))) for n in TRAVERSALS], ["traversal", "o"])
    g = f"g AS (SELECT tensor, {d.div('r', 8)} * 8 + {d.div('c', 8)} AS t, r % 8 AS y, c % 8 AS x, w FROM words), a AS ({parts}), s AS (SELECT tensor, traversal, {d.xor('w', 'coalesce(lag(w) OVER (PARTITION BY tensor, t, traversal ORDER BY o), 0)')} AS res FROM a)"
    ones = d.pop("res")
    return g, f"SELECT tensor, traversal, {long(f'sum({ones})')} AS ones, {long('sum(CASE WHEN res < 128 THEN 1 ELSE 0 END)')} AS small FROM s GROUP BY tensor, traversal"


@definition("words")
def pair_keys(d):
    """Inventories of two checkpoints by (name, shape): the second lacks tensor 0 and has one of another shape."""
    b = "a AS (SELECT tensor, max(r) + 1 AS n_rows FROM words GROUP BY tensor), b AS (SELECT tensor, CASE WHEN tensor = 3 THEN n_rows + 1 ELSE n_rows END AS n_rows FROM a WHERE tensor <> 0)"
    side = lambda x, y, name: f"SELECT '{name}' AS side, tensor, {long('n_rows')} AS n_rows FROM {x} WHERE NOT EXISTS (SELECT 1 FROM {y} WHERE {y}.tensor = {x}.tensor AND {y}.n_rows = {x}.n_rows)"
    return b, f"SELECT 'both' AS side, a.tensor, {long('a.n_rows')} AS n_rows FROM a JOIN b ON a.tensor = b.tensor AND a.n_rows = b.n_rows UNION ALL {side('a', 'b', 'base')} UNION ALL {side('b', 'a', 'target')}"


@definition("words")
def cross_layer_xor(d):
    """Each tensor against the last before it with a row of the same place."""
    x = f"x AS (SELECT tensor, r, c, w, lag(w) OVER (PARTITION BY r, c ORDER BY tensor) AS ref FROM words), y AS (SELECT tensor, {d.xor('w', 'ref')} AS res, {d.xor(d.shr('w', 7), d.shr('ref', 7))} & 255 AS eres FROM x WHERE ref IS NOT NULL)"
    ones = d.pop("res")
    return x, f"SELECT tensor, {long('count(*)')} AS n, {six(f'avg({ones})')} AS mean_ones, {long('sum(CASE WHEN eres = 0 THEN 1 ELSE 0 END)')} AS same_exponent FROM y GROUP BY tensor"


def tiles(d, value="w", height=1, width=8):
    """Content of small tiles as text: a key that equals when tiles do."""
    key = d.joined(f"concat({value}, ' ')", "r * 64 + c")
    return f"SELECT tensor, {d.div('r', height)} * {64 // width} + {d.div('c', width)} AS tile, {key} AS content FROM words GROUP BY tensor, {d.div('r', height)} * {64 // width} + {d.div('c', width)}"


@definition("words")
def duplicate_refs(d):
    """Tiles of two exponents: the first of each content, and those that refer to it."""
    e = f"({d.shr('w', 7)} & 255)"
    t = f"t AS ({tiles(d, e, 1, 2)}), f AS (SELECT tensor, tile, content, min(tile) OVER (PARTITION BY tensor, content) AS first_tile FROM t)"
    return t, f"SELECT tensor, {long('count(*)')} AS tiles, {long('sum(CASE WHEN first_tile < tile THEN 1 ELSE 0 END)')} AS refs, {long('sum(first_tile)')} AS first_sum FROM f GROUP BY tensor"


@definition("words")
def previous_tile_refs(d):
    x = f"x AS (SELECT tensor, {d.div('r', 4)} AS tile, w, lag(w) OVER (PARTITION BY tensor, r % 4, c ORDER BY r) AS ref FROM words), y AS (SELECT tensor, tile, {d.xor('w', 'coalesce(ref, 0)')} AS res FROM x)"
    ones = d.pop("res")
    return x, f"SELECT tensor, tile, {six(f'avg({ones})')} AS mean_ones, {long('count(DISTINCT res)')} AS distinct_res FROM y GROUP BY tensor, tile"


@definition("words")
def transformed_refs(d):
    """Pairs of exponents that equal an earlier pair as it is, with its words swapped, or with signs flipped."""
    w = d.shr("w", 7)
    p = f"p AS (SELECT tensor, r * 32 + {d.div('c', 2)} AS tile, max(CASE WHEN c % 2 = 0 THEN {w} END) AS a, max(CASE WHEN c % 2 = 1 THEN {w} END) AS b FROM words GROUP BY tensor, r * 32 + {d.div('c', 2)})"
    flip = lambda x: d.xor(x, 256)
    v = f"v AS (SELECT tensor, tile, 0 AS xf, a, b FROM p UNION ALL SELECT tensor, tile, 1, b, a FROM p UNION ALL SELECT tensor, tile, 2, {flip('a')}, {flip('b')} FROM p), k AS (SELECT tensor, a, b, {d.argmin('tile', 'tile', 'xf')} AS tile, {d.argmin('xf', 'tile', 'xf')} AS xf FROM v GROUP BY tensor, a, b)"
    return f"{p}, {v}", f"SELECT p.tensor, {long('k.xf')} AS xf, {long('count(*)')} AS refs FROM p JOIN k ON p.tensor = k.tensor AND p.a = k.a AND p.b = k.b AND k.tile < p.tile GROUP BY p.tensor, k.xf"


@definition("words")
def patch_apply(d):
    """Words of two kept bits patched back to the exact ones at the places where they differ."""
    p = f"f AS (SELECT tensor, r, c, w, {fields(d)} FROM words), b AS (SELECT tensor, r, c, w, {keep_k(d, 6)} AS kept FROM f), p AS (SELECT tensor, r, c, w FROM b WHERE w <> kept)"
    return p, f"SELECT b.tensor, {long('count(*)')} AS n, {long('count(p.w)')} AS patched, {long('sum(CASE WHEN coalesce(p.w, b.kept) <> b.w THEN 1 ELSE 0 END)')} AS differing FROM b LEFT JOIN p ON b.tensor = p.tensor AND b.r = p.r AND b.c = p.c GROUP BY b.tensor"


@definition("words")
def archive_semi_join(d):
    return "k AS (SELECT DISTINCT tensor FROM words WHERE tensor % 3 = 0)", f"SELECT w.tensor, {long('count(*)')} AS n FROM words w WHERE EXISTS (SELECT 1 FROM k WHERE k.tensor = w.tensor) GROUP BY w.tensor"


@definition("words")
def stable_permutation(d):
    """Mantissas in order of exponent, place: ranks from counts below and ranks within an exponent."""
    f = f"f AS (SELECT tensor, r, c, {fields(d)} FROM words), n AS (SELECT tensor, e, count(*) AS n FROM f GROUP BY tensor, e), b AS (SELECT tensor, e, coalesce(sum(n) OVER (PARTITION BY tensor ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM n), k AS (SELECT tensor, e, m, row_number() OVER (PARTITION BY tensor, e ORDER BY r, c) AS nth FROM f)"
    return f, f"SELECT k.tensor, k.e, {long('min(b.base + k.nth - 1)')} AS first_rank, {long('max(b.base + k.nth - 1)')} AS last_rank, {long('sum((b.base + k.nth) * k.m)')} AS checksum FROM k JOIN b ON k.tensor = b.tensor AND k.e = b.e GROUP BY k.tensor, k.e"


@definition("words")
def holdout_split(d):
    n = f"n AS (SELECT tensor, max(r) + 1 AS n FROM words GROUP BY tensor), h AS (SELECT tensor, n, n - least(greatest(1, CAST({d.rint('n * 0.2')} AS BIGINT)), n - 1) AS cut FROM n)"
    return n, f"SELECT w.tensor, w.r >= h.cut AS held_out, {long('count(*)')} AS n_words, {long('sum(w.w)')} AS word_sum FROM words w JOIN h ON w.tensor = h.tensor GROUP BY w.tensor, w.r >= h.cut"


@definition("words")
def row_recovery(d):
    """The fifth of rows with the largest mean magnitude, and what their map costs."""
    m = f"m AS (SELECT tensor, r, round(avg(abs(x)), 9) AS mag FROM words GROUP BY tensor, r), n AS (SELECT tensor, r, mag, row_number() OVER (PARTITION BY tensor ORDER BY mag DESC, r) AS k, count(*) OVER (PARTITION BY tensor) AS n FROM m)"
    return m, f"SELECT tensor, r, {six('mag')} AS magnitude, {long('k')} AS rank FROM n WHERE k <= greatest(1, CAST({d.rint('n * 0.2')} AS BIGINT))"


@definition("documents")
def frequency_tiers(d):
    """Words by count, ties by the word: the first 100, then those before which 9 %, then 30 % of all words lie, then the
    rest. Counts of counts give the words and the mass before each count, so only words of one count are ordered
    together, and that only where a tier ends among them."""
    t = f"t AS (SELECT {d.explode_words('text')} AS tok FROM documents), n AS (SELECT tok, count(*) AS n FROM t GROUP BY tok), cc AS (SELECT n, count(*) AS words, sum(n) AS mass FROM n GROUP BY n)"
    b = "cb AS (SELECT n, words, mass, sum(mass) OVER () AS total, sum(words) OVER (ORDER BY n DESC) - words AS words_before, sum(mass) OVER (ORDER BY n DESC) - mass AS mass_before FROM cc)"
    # the k-th word of a count has words_before + k before it, and mass_before + n k
    top = "least(greatest(100 - words_before, 0), words)"
    cut = lambda share: f"least(greatest(CAST(ceil(({share} * total - mass_before) / n) AS BIGINT), 0), words)"
    ends = f"ce AS (SELECT n, words, {top} AS a, greatest({top}, {cut('0.09')}) AS b, greatest({top}, {cut('0.3')}) AS c FROM cb)"
    parts = d.stacked("ce", ["n"], [(long(k), long(x)) for k, x in ((7, "a"), (6, "b - a"), (5, "c - b"), (4, "words - c"))], ["keep", "tokens"])
    return f"{t}, {b}, {ends}", f"SELECT keep, {long('sum(tokens)')} AS tokens, {long('sum(tokens * n)')} AS mass FROM ({parts}) q WHERE tokens > 0 GROUP BY keep"


@definition("words")
def outlier_top_k(d):
    o = "o AS (SELECT tensor, r, c, w, row_number() OVER (PARTITION BY tensor ORDER BY abs(x) DESC, r, c) AS k, count(*) OVER (PARTITION BY tensor) AS n FROM words)"
    return o, f"SELECT tensor, r, c, w, {long('k')} AS rank FROM o WHERE k <= CAST(ceil(n * 0.005) AS BIGINT)"
