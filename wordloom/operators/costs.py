"""Encodings priced in complete bytes, the chooser, and reports on top of it.

A tile of 4 x 64 words is priced by every encoding of the menu from a few aggregates; the cheapest wins, ties by number
of the encoding. Prices hold the tile's header of 17 bytes, tables and all.
"""

from __future__ import annotations

from wordloom.operators.fields import band, bits_needed, bpw, fields
from wordloom.operators.stats import pair
from wordloom.plans.dialect import definition, long, six

HEADER = 17
# Fixed numbers of the encodings, which decide ties.
MODES = {"raw": 0, "constant": 1, "value_dict": 2, "prev_value": 3, "prev_row": 4, "const_pred": 5, "duplicate_ref": 6, "components": 7, "ref_prev_tile": 8, "exp_huffman": 9, "exp_spatial": 10, "exp_hier": 11, "cross_layer": 12, "bit_planes": 13, "grammar": 14, "transformed_ref": 15, "position_dict": 16, "exp_rans": 17}


def in_tile(d):
    """Words of 4 x 64 tiles with their neighbours inside the tile (0 outside)."""
    return f"g AS (SELECT tensor, {d.div('r', 4)} AS tile, w, {d.shr('w', 7)} & 255 AS e, CASE WHEN r % 4 = 0 AND c = 0 THEN 0 ELSE prev_w END AS p, CASE WHEN r % 4 = 0 THEN 0 ELSE up_w END AS u FROM words)"


def shapes(d):
    """CTE bodies: n, distinct symbols and how many differ from the commonest, for words, exponents and residuals, in
    one scan. XOR with a constant renames words, so const_pred has the numbers of the words themselves."""
    symbols = {"word": "w", "exponent": "e", "prev_value": d.xor("w", "p"), "prev_row": d.xor("w", "u")}
    stack = d.stacked("g", ["tensor", "tile"], [(f"'{n}'", long(x)) for n, x in symbols.items()], ["kind", "sym"])
    return f"""{in_tile(d)}, sy AS ({stack}),
sc AS (SELECT tensor, tile, kind, sym, count(*) AS n FROM sy GROUP BY tensor, tile, kind, sym),
sh AS (SELECT tensor, tile, kind, sum(n) AS n, count(*) AS k, sum(n) - max(n) AS x FROM sc GROUP BY tensor, tile, kind)"""


def position_width(n):
    return f"(CASE WHEN {n} <= 256 THEN 1 WHEN {n} <= 65536 THEN 2 ELSE 4 END)"


def residual_cost(d):
    """Cheapest packing of n residuals of which x differ from the default, k distinct."""
    bits = f"({bits_needed(d, 'k')})"
    ceil8 = lambda x: d.div(f"{x} + 7", 8)
    many = "999999999"
    return f"least(1 + 2 * n, CASE WHEN k = 1 THEN 3 ELSE {many} END, 7 + x * ({position_width('n')} + 2), 3 + {ceil8('n')} + 2 * x, CASE WHEN k BETWEEN 2 AND 4 THEN 3 + 2 * k + {ceil8(f'n * {bits}')} ELSE {many} END)"


def prices(d):
    bits = f"({bits_needed(d, 'k')})"
    ceil8 = lambda x: d.div(f"{x} + 7", 8)
    res = residual_cost(d)
    rows = [
        ("raw", "word", "2 * n", "TRUE"),
        ("constant", "word", "2", "k = 1"),
        ("value_dict", "word", f"2 + 2 * k + {ceil8(f'n * {bits}')}", f"k BETWEEN 2 AND 16 AND 2 + 2 * k + {ceil8(f'n * {bits}')} < 2 * n"),
        ("components", "exponent", f"5 + n + CASE WHEN k > 1 AND k <= 16 THEN 2 + k + {ceil8(f'n * {bits}')} ELSE n END", f"5 + n + CASE WHEN k > 1 AND k <= 16 THEN 2 + k + {ceil8(f'n * {bits}')} ELSE n END < 2 * n"),
        ("prev_value", "prev_value", res, "TRUE"),
        ("prev_row", "prev_row", res, "TRUE"),
        ("const_pred", "word", f"2 + {res}", "TRUE"),
    ]
    priced = d.stacked("sh", ["tensor", "tile", "n"], [(long(MODES[m]), f"'{m}'", long(f"CASE WHEN kind = '{kind}' AND {when} THEN {HEADER} + {cost} END")) for m, kind, cost, when in rows], ["mode_id", "mode_name", "bytes"])
    return f"SELECT * FROM ({priced}) pp WHERE bytes IS NOT NULL"


def chosen(d):
    return f"{shapes(d)}, pr AS ({prices(d)}), ch AS (SELECT tensor, tile, max(n) AS n, min(bytes) AS bytes, {d.argmin('mode_id', 'bytes', 'mode_id')} AS mode_id, {d.argmin('mode_name', 'bytes', 'mode_id')} AS mode_name FROM pr GROUP BY tensor, tile)"


@definition("words")
def residual_pack_cost(d):
    return f"{shapes(d)}", f"SELECT tensor, tile, CASE WHEN kind = 'word' THEN 'const_pred' ELSE kind END AS kind, {long(residual_cost(d))} AS bytes, {long('k')} AS distinct_symbols, {long('x')} AS exceptions FROM sh WHERE kind <> 'exponent'"


@definition("words")
def candidate_prices(d):
    return f"{shapes(d)}, pr AS ({prices(d)})", f"SELECT tensor, tile, {long('mode_id')} AS mode_id, mode_name, {long('bytes')} AS bytes FROM pr"


@definition("words")
def codec_argmin(d):
    return chosen(d), f"SELECT tensor, tile, {long('mode_id')} AS mode_id, mode_name, {long('bytes')} AS bytes FROM ch"


@definition("words")
def mode_usage(d):
    return f"{chosen(d)}, u AS (SELECT tensor, mode_name, count(*) AS tiles, sum(bytes) AS bytes FROM ch GROUP BY tensor, mode_name)", f"SELECT tensor, mode_name, {long('tiles')} AS tiles, {long('bytes')} AS bytes, {six('tiles * 1.0 / sum(tiles) OVER (PARTITION BY tensor)')} AS share FROM u"


@definition("words")
def total_rollup(d):
    return chosen(d), f"SELECT coalesce(CAST(tensor AS BIGINT), -1) AS tensor, {long('sum(n)')} AS n_words, {long('sum(bytes)')} AS bytes, {six(bpw('sum(bytes)', 'sum(n)'))} AS bpw FROM ch GROUP BY ROLLUP (tensor)"


@definition("words")
def sample_projection(d):
    """Bytes of a tensor from every fourth tile, plus words that no tile holds at 16 bits."""
    return f"{chosen(d)}, s AS (SELECT tensor, sum(CASE WHEN tile % 4 = 0 THEN bytes ELSE 0 END) AS b, sum(CASE WHEN tile % 4 = 0 THEN 1 ELSE 0 END) AS k, count(*) AS tiles, sum(n) AS n FROM ch GROUP BY tensor)", f"SELECT tensor, {long(d.rint('b * 1.0 / k * tiles + 20'))} AS projected, {long('2 * n')} AS raw_bytes FROM s"


def qualified(d):
    return f"{chosen(d)}, t AS (SELECT tensor, sum(n) AS n, sum(bytes) AS bytes FROM ch GROUP BY tensor), q AS (SELECT tensor, n, bytes, {bpw('bytes', 'n')} AS bpw FROM t)"


@definition("words")
def qualify_leaderboard(d):
    """The flagship: scan, price, choose, sum up by tensor, band, order."""
    return qualified(d), f"SELECT tensor, {long('n')} AS n_words, {long('bytes')} AS bytes, {six('bpw')} AS bpw, {band('bpw')} AS band, bpw <= 4 AS high_potential FROM q ORDER BY bpw, tensor LIMIT 15"


@definition("words")
def qualification_summary(d):
    return qualified(d), f"SELECT {long('sum(n)')} AS n_words, {long('sum(bytes)')} AS bytes, {six(bpw('sum(bytes)', 'sum(n)'))} AS bpw, {six('min(bpw)')} AS best, {six('max(bpw)')} AS worst, FALSE AS one_gb_qualified FROM q"


@definition("words")
def block_size_choice(d):
    """Raw against components at blocks of 64, 256 and 1024 words: the cheapest block of each tensor."""
    packed = d.div(f"n * ({bits_needed(d, 'k')}) + 7", 8)
    parts = d.stacked("f", ["tensor", "e"], [(long(rows * 64), long(d.div("r", rows))) for rows in (1, 4, 16)], ["block", "tile"])
    k = f"f AS (SELECT tensor, r, {d.shr('w', 7)} & 255 AS e FROM words), b AS ({parts}), s AS (SELECT tensor, block, tile, count(*) AS n, count(DISTINCT e) AS k FROM b GROUP BY tensor, block, tile)"
    cost = f"{HEADER} + least(2 * n, 5 + n + CASE WHEN k > 1 AND k <= 16 THEN 2 + k + {packed} ELSE n END)"
    t = f"t AS (SELECT tensor, block, sum({cost}) AS bytes FROM s GROUP BY tensor, block)"
    return f"{k}, {t}", f"SELECT tensor, {long(d.argmin('block', 'bytes', 'block'))} AS block, {long('min(bytes)')} AS bytes FROM t GROUP BY tensor"


@definition("words")
def bit_plane_cost(d):
    """Sixteen planes of a tile: none, all, a list of places, or a bitmap."""
    bits = ", ".join(f"sum({d.shr('w', i)} & 1) AS b{i}" for i in range(16))
    cost = lambda i: f"CASE WHEN b{i} = 0 OR b{i} = n THEN 1 ELSE least(2 + 4 + {position_width('n')} * least(b{i}, n - b{i}), 1 + {d.div('n + 7', 8)}) END"
    same = " + ".join(f"CASE WHEN b{i} = 0 OR b{i} = n THEN 1 ELSE 0 END" for i in range(16))
    return f"p AS (SELECT tensor, {d.div('r', 4)} AS tile, count(*) AS n, {bits} FROM words GROUP BY tensor, {d.div('r', 4)})", f"SELECT tensor, tile, {long(' + '.join(cost(i) for i in range(16)))} AS bytes, {long(same)} AS constant_planes FROM p"


@definition("words")
def position_dict_cost(d):
    """A default word and a palette of up to 16 exceptions, on the high bits of the exponent."""
    g = f"g AS (SELECT tensor, {d.div('r', 4)} AS tile, {d.shr('w', 9)} AS v FROM words), c AS (SELECT tensor, tile, v, count(*) AS n FROM g GROUP BY tensor, tile, v), s AS (SELECT tensor, tile, sum(n) AS n, count(*) - 1 AS k, sum(n) - max(n) AS x FROM c GROUP BY tensor, tile)"
    bits = f"({bits_needed(d, 'k')})"
    body = f"least(4 + x * {position_width('n')}, {d.div('n + 7', 8)}) + {d.div(f'x * {bits} + 7', 8)}"
    return g, f"SELECT tensor, tile, {long(f'CASE WHEN k <= 16 THEN 5 + 2 * k + {body} ELSE 2 * n END')} AS bytes FROM s"


@definition("words")
def escape_dictionary(d):
    """The 255 commonest words of all tensors in a byte each, others after an escape in three."""
    k = "k AS (SELECT w, count(*) AS n FROM words GROUP BY w), p AS (SELECT w FROM k ORDER BY n DESC, w LIMIT 255)"
    return k, f"SELECT words.tensor, {long('count(*) + 2 * sum(CASE WHEN p.w IS NULL THEN 1 ELSE 0 END)')} AS bytes, {long('sum(CASE WHEN p.w IS NULL THEN 1 ELSE 0 END)')} AS misses FROM words LEFT JOIN p ON words.w = p.w GROUP BY words.tensor"


@definition("words")
def local_escape_dictionary(d):
    k = "k AS (SELECT tensor, w, count(*) AS n FROM words GROUP BY tensor, w), o AS (SELECT tensor, n, row_number() OVER (PARTITION BY tensor ORDER BY n DESC, w) AS nth FROM k)"
    return k, f"SELECT tensor, {long('512 + sum(n) + 2 * sum(CASE WHEN nth > 255 THEN n ELSE 0 END)')} AS bytes FROM o GROUP BY tensor"


@definition("words")
def nibble_cost(d):
    """High twelve bits: the commonest of a tile in place of all, and nibbles for the rest where they agree."""
    g = f"g AS (SELECT tensor, {d.div('r', 4)} AS tile, {d.shr('w', 4)} AS hi FROM words), c AS (SELECT tensor, tile, hi, count(*) AS n FROM g GROUP BY tensor, tile, hi), s AS (SELECT tensor, tile, sum(n) AS n, max(n) AS top, count(*) AS k FROM c GROUP BY tensor, tile)"
    return g, f"SELECT tensor, tile, {long('k')} AS prefixes, {long('top')} AS hits, {long('least(2 * n, 3 + ' + d.div('n + 7', 8) + ' + ' + d.div('top + 1', 2) + ' + 2 * (n - top))')} AS bytes FROM s"


@definition("words")
def sparse_patch_cost(d):
    c = f"{pair(d, 5)}, s AS (SELECT tensor, count(*) AS n, sum(CASE WHEN base <> target THEN 1 ELSE 0 END) AS x FROM p GROUP BY tensor)"
    return c, f"SELECT tensor, {long('x')} AS changed, {long('least(4 + 4 * x, ' + d.div('n + 7', 8) + ') + 2 * x')} AS bytes, {six(bpw('least(4 + 4 * x, ' + d.div('n + 7', 8) + ') + 2 * x', 'n'))} AS bpw FROM s"


@definition("words")
def pair_evaluation(d):
    """Of a pair: raw, sparse patch and packed XOR residual, the best by bytes, and a total of all pairs."""
    c = f"{pair(d, 5)}, x AS (SELECT tensor, {d.xor('base', 'target')} AS res FROM p), k AS (SELECT tensor, res, count(*) AS n FROM x GROUP BY tensor, res), s AS (SELECT tensor, sum(n) AS n, count(*) AS k, sum(n) - max(n) AS x FROM k GROUP BY tensor)"
    m = f"m AS (SELECT tensor, n, 2 * n AS raw, least(4 + 4 * x, {d.div('n + 7', 8)}) + 2 * x AS patch, {residual_cost(d)} AS residual FROM s)"
    return f"{c}, {m}", f"SELECT coalesce(CAST(tensor AS BIGINT), -1) AS tensor, {long('sum(raw)')} AS raw_bytes, {long('sum(patch)')} AS patch_bytes, {long('sum(residual)')} AS residual_bytes, {long('sum(least(raw, patch, residual))')} AS best_bytes FROM m GROUP BY ROLLUP (tensor)"


@definition("words")
def adaptive_blocks(d):
    """Mantissas in blocks of 256: seven bits each, or one bit for a hit of the context rule and eight for a miss."""
    g = f"g AS (SELECT tensor, {d.div('r', 4)} AS block, w & 127 AS m, {d.shr('w', 7)} & 127 AS e, coalesce(prev_w, 0) & 127 AS p FROM words), s AS (SELECT tensor, block, count(*) AS n, sum(CASE WHEN m = p THEN 1 ELSE 0 END) AS copies, sum(CASE WHEN m = e THEN 1 ELSE 0 END) AS exps FROM g GROUP BY tensor, block)"
    return g, f"SELECT tensor, {long('19 + sum(' + d.div('7 * n + 7', 8) + ')')} AS raw_bytes, {long('19 + sum(' + d.div('copies + 8 * (n - copies) + 7', 8) + ')')} AS copy_bytes, {long('19 + ' + d.div('2 * count(*) + 7', 8) + ' + sum(least(' + d.div('7 * n + 7', 8) + ', ' + d.div('copies + 8 * (n - copies) + 7', 8) + ', ' + d.div('exps + 8 * (n - exps) + 7', 8) + '))')} AS mixed_bytes FROM s GROUP BY tensor"


@definition("words")
def pair_dictionary(d):
    """Horizontal pairs of exponents: the 64 commonest of even tensors as an index, others in 16 bits after a flag."""
    p = f"p AS (SELECT tensor, ({d.shr('left_w', 7)} & 255) * 256 + ({d.shr('w', 7)} & 255) AS pair FROM words WHERE c % 2 = 1), k AS (SELECT pair, count(*) AS n FROM p WHERE tensor % 2 = 0 GROUP BY pair), t AS (SELECT pair FROM k ORDER BY n DESC, pair LIMIT 64)"
    return p, f"SELECT p.tensor, {long('sum(CASE WHEN t.pair IS NULL THEN 17 ELSE 7 END)')} AS bits, {six('avg(CASE WHEN t.pair IS NULL THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END)')} AS hit_rate FROM p LEFT JOIN t ON p.pair = t.pair GROUP BY p.tensor"


@definition("words")
def matrix_probe(d):
    """Raw, copy and XOR residuals in planes, for five bits of 16 x 16 tiles."""
    g = f"g AS (SELECT tensor, {d.div('r', 16)} * 4 + {d.div('c', 16)} AS tile, {d.shr('w', 2)} & 31 AS v, CASE WHEN c % 16 = 0 THEN 0 ELSE {d.shr('left_w', 2)} & 31 END AS l FROM words), x AS (SELECT tensor, tile, v, {d.xor('v', 'l')} AS res FROM g)"
    planes = " + ".join(f"CASE WHEN sum({d.shr('res', b)} & 1) = 0 THEN 1 ELSE 1 + {d.div('count(*) + 7', 8)} END" for b in range(5))
    return f"{g}, s AS (SELECT tensor, tile, count(*) AS n, {planes} AS planes FROM x GROUP BY tensor, tile)", f"SELECT tensor, tile, {long(d.div('5 * n + 7', 8))} AS packed_bytes, {long('planes')} AS plane_bytes, planes < {d.div('5 * n + 7', 8)} AS keeps FROM s"


@definition("words")
def verify_exact(d):
    """Words rebuilt from their fields against the words, by place."""
    b = f"f AS (SELECT tensor, r, c, {fields(d)} FROM words), b AS (SELECT tensor, r, c, ({d.shl('s', 15)} | {d.shl('e', 7)} | m) AS w FROM f)"
    return b, f"SELECT coalesce(a.tensor, b.tensor) AS tensor, {long('count(*)')} AS n_words, {long('sum(CASE WHEN a.w IS DISTINCT FROM b.w THEN 1 ELSE 0 END)')} AS differing FROM words a FULL OUTER JOIN b ON a.tensor = b.tensor AND a.r = b.r AND a.c = b.c GROUP BY coalesce(a.tensor, b.tensor)"
