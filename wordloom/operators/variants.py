"""Variants of labels, codes, pairs, runs, contexts and tile codecs, and the choice of tiles that pay for their map."""

from __future__ import annotations

from wordloom.operators.fields import bits_needed, bpw, fields, names
from wordloom.plans.dialect import definition, long, six


def projection(d):
    cases = {"q_proj|query": "q", "k_proj|key": "k", "v_proj|value": "v", "o_proj|out_proj|attn.c_proj": "o", "gate_proj|w1": "gate", "up_proj|w3": "up", "down_proj|w2": "down"}
    return "CASE " + " ".join(f"WHEN {d.matches('name', p)} THEN '{label}'" for p, label in cases.items()) + " ELSE 'none' END"


@definition()
def projection_labels(d):
    """Projection, sensitivity by place, kind of storage and importance weight of each name."""
    layer = d.extract("name", "layers[.]([0-9]+)", 1)
    n = f"n AS (SELECT name, CASE WHEN {layer} = '' THEN -1 ELSE CAST({layer} AS BIGINT) END AS layer, {projection(d)} AS projection FROM {names(d)} z), m AS (SELECT max(layer) AS last FROM n)"
    place = f"CASE WHEN {d.matches('name', 'embed|wte|lm_head')} THEN 'vocabulary' WHEN {d.matches('name', 'norm|bias$')} THEN 'vector' WHEN layer = 0 OR layer = last THEN 'edge' WHEN layer < 0 THEN 'none' ELSE 'middle' END"
    weight = "CASE projection WHEN 'v' THEN 1.5 WHEN 'o' THEN 1.25 WHEN 'down' THEN 1.25 WHEN 'q' THEN 1.0 WHEN 'k' THEN 1.0 ELSE 0.75 END"
    return n, f"SELECT name, layer, projection, {place} AS place, {six(weight)} AS weight FROM n CROSS JOIN m"


@definition("words")
def kept_codes(d):
    """Mantissas of which the top k bits are kept, as codes to the right and back to the left, for k of 1 to 6."""
    rows = [(long(k), long(d.shr("m", 7 - k)), long(d.shl(d.shr("m", 7 - k), 7 - k))) for k in range(1, 7)]
    return f"f AS (SELECT tensor, w & 127 AS m FROM words), k AS ({d.stacked('f', ['tensor', 'm'], rows, ['keep', 'code', 'back'])})", f"SELECT tensor, keep, {long('max(code)')} AS top_code, {long('count(DISTINCT code)')} AS codes, {long('sum(m - back)')} AS lost FROM k GROUP BY tensor, keep"


@definition()
def bit_estimates(d):
    """Packed bits, squared error of a uniform step, and bits over four, for each width of a 4096-word tensor in groups of 64."""
    return f"b AS (SELECT i AS bits FROM {d.numbers(17)} z WHERE i IN (2, 3, 4, 5, 6, 8, 16))", f"SELECT {long('bits')} AS bits, {long('CASE WHEN bits = 16 THEN 65536 ELSE 4096 * bits + 64 * 24 END')} AS packed_bits, {six('CASE WHEN bits >= 16 THEN 0 ELSE 1.0 / POWER(POWER(2, bits) - 1, 2) END')} AS error_proxy, {long('greatest(bits - 4, 0) * 4096')} AS margin_bits FROM b"


@definition("words")
def pair_kinds(d):
    """Pairs of exponents side by side, one above the other, and along a row walked to and fro; words without a partner."""
    e = lambda x: f"({d.shr(x, 7)} & 255)"
    g = f"h AS (SELECT tensor, max(r) + 1 AS h, max(c) + 1 AS w FROM words GROUP BY tensor), g AS (SELECT w.tensor, w.r, w.c, h.h, h.w AS wide, {e('w.w')} AS e, {e('w.left_w')} AS l, {e('w.up_w')} AS u FROM words w JOIN h ON w.tensor = h.tensor)"
    rows = [
        ("'horizontal'", long("CASE WHEN c % 2 = 1 THEN l * 256 + e END"), long("CASE WHEN c % 2 = 0 AND c = wide - 1 THEN 1 ELSE 0 END")),
        ("'vertical'", long("CASE WHEN r % 2 = 1 THEN u * 256 + e END"), long("CASE WHEN r % 2 = 0 AND r = h - 1 THEN 1 ELSE 0 END")),
        ("'walk'", long("CASE WHEN c % 2 = 1 THEN CASE WHEN r % 2 = 0 THEN l * 256 + e ELSE e * 256 + l END END"), long("CASE WHEN c % 2 = 0 AND c = wide - 1 THEN 1 ELSE 0 END")),
    ]
    return f"{g}, k AS ({d.stacked('g', ['tensor'], rows, ['kind', 'pair', 'odd'])})", f"SELECT tensor, kind, {long('count(pair)')} AS pairs, {long('count(DISTINCT pair)')} AS distinct_pairs, {long('sum(odd)')} AS left_over, {long('sum(pair)')} AS pair_sum FROM k GROUP BY tensor, kind"


@definition("words")
def run_pieces(d):
    """Runs of equal exponents in a row, none over eight long: longer ones go on as another piece."""
    x = f"x AS (SELECT tensor, r, c, {d.shr('w', 7)} & 255 AS e, {d.shr('left_w', 7)} & 255 AS p FROM words), y AS (SELECT tensor, r, c, e, sum(CASE WHEN e = p THEN 0 ELSE 1 END) OVER (PARTITION BY tensor, r ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM x)"
    z = f"z AS (SELECT tensor, r, e, island, row_number() OVER (PARTITION BY tensor, r, island ORDER BY c) - 1 AS k FROM y), p AS (SELECT tensor, r, island, {d.div('k', 8)} AS piece, e, count(*) AS len FROM z GROUP BY tensor, r, island, {d.div('k', 8)}, e)"
    return f"{x}, {z}", f"SELECT tensor, {long('len')} AS len, {long('count(*)')} AS pieces, {long('sum(e)')} AS exponent_sum FROM p GROUP BY tensor, len"


@definition("words")
def lower_half_drop(d):
    """Rows by mean magnitude: the lower half is dropped; energy that stays, and bytes with a bitmap of the rows."""
    m = "m AS (SELECT tensor, r, round(avg(abs(x)), 9) AS mag, sum(x * x) AS energy, count(*) AS n FROM words GROUP BY tensor, r), k AS (SELECT tensor, energy, n, row_number() OVER (PARTITION BY tensor ORDER BY mag DESC, r) AS k, count(*) OVER (PARTITION BY tensor) AS h FROM m)"
    stays = f"k <= h - {d.div('h', 2)}"
    return m, f"SELECT tensor, {long(f'sum(CASE WHEN {stays} THEN 1 ELSE 0 END)')} AS rows_kept, {six(f'sum(CASE WHEN {stays} THEN energy ELSE 0 END) / sum(energy)')} AS energy_share, {long(f'sum(CASE WHEN {stays} THEN 2 * n ELSE 0 END) + ' + d.div('max(h) + 7', 8))} AS bytes FROM k GROUP BY tensor"


@definition("words")
def same_role_reference(d):
    """Tensors of a role (here their number modulo three): the last before each with the same role and as many columns."""
    t = "t AS (SELECT tensor, tensor % 3 AS role, max(c) + 1 AS cols, max(r) + 1 AS n_rows FROM words GROUP BY tensor), p AS (SELECT tensor, role, cols, n_rows, lag(tensor) OVER (PARTITION BY role, cols ORDER BY tensor) AS ref FROM t)"
    x = f"x AS (SELECT a.tensor, p.ref, {d.xor('a.w', 'b.w')} AS res FROM words a JOIN p ON a.tensor = p.tensor JOIN words b ON b.tensor = p.ref AND b.r = a.r AND b.c = a.c)"
    return f"{t}, {x}", f"SELECT tensor, {long('max(ref)')} AS reference, {long('count(*)')} AS n, {six('avg(' + d.pop('res') + ')')} AS mean_ones FROM x GROUP BY tensor"


@definition("words")
def six_context_rules(d):
    """Hits of six integer rules for a mantissa, over the first 32 blocks of four rows and over all; the best of the first."""
    g = f"g AS (SELECT tensor, {d.div('r', 4)} AS block, w & 127 AS m, {d.shr('w', 7)} & 255 AS e, coalesce(prev_w, 0) & 127 AS p, (r * 64 + c) % 256 AS pos FROM words)"
    rules = {"copy": "p", "position": "pos & 127", "next": "(p + 1) & 127", "exponent": "e & 127", "mixed": f"{d.xor(d.xor('p', 'e'), 'pos')} & 127", "mean": f"{d.shr('(p + e)', 1)} & 127"}
    rows = [(long(i), f"'{n}'", long(f"CASE WHEN m = ({rule}) THEN 1 ELSE 0 END")) for i, (n, rule) in enumerate(rules.items())]
    s = f"k AS ({d.stacked('g', ['tensor', 'block'], rows, ['id', 'rule', 'hit'])}), s AS (SELECT tensor, id, rule, sum(CASE WHEN block < 32 THEN hit ELSE 0 END) AS early, sum(hit) AS hits FROM k GROUP BY tensor, id, rule)"
    return f"{g}, {s}", f"SELECT tensor, rule, {long('early')} AS early_hits, {long('hits')} AS hits, row_number() OVER (PARTITION BY tensor ORDER BY early DESC, id) = 1 AS frozen FROM s"


@definition("words")
def depth_mixture_nll(d):
    """Bits of mantissa planes under the mean of two estimates: by the same bit of the word before, and of the two before."""
    f = "f AS (SELECT tensor, w & 127 AS m, coalesce(left_w, 0) & 127 AS p, coalesce(lag(left_w) OVER (PARTITION BY tensor, r ORDER BY c), 0) & 127 AS q FROM words)"
    rows = [(long(b), long(f"{d.shr('m', b)} & 1"), long(f"{d.shr('p', b)} & 1"), long(f"({d.shr('p', b)} & 1) * 2 + ({d.shr('q', b)} & 1)")) for b in range(7)]
    k = f"k AS ({d.stacked('f', ['tensor'], rows, ['plane', 'bit', 'one', 'two'])}), c AS (SELECT tensor, plane, one, two, bit, count(*) AS n FROM k GROUP BY tensor, plane, one, two, bit)"
    w = "w AS (SELECT tensor, plane, bit, n, sum(n) OVER (PARTITION BY tensor, plane, one, bit) AS n1, sum(n) OVER (PARTITION BY tensor, plane, one) AS t1, n AS n2, sum(n) OVER (PARTITION BY tensor, plane, one, two) AS t2 FROM c)"
    return f"{f}, {k}, {w}", f"SELECT tensor, plane, {six('sum(n * -log2(((n1 + 0.5) / (t1 + 1) + (n2 + 0.5) / (t2 + 1)) / 2)) / sum(n)')} AS bits FROM w GROUP BY tensor, plane"


@definition("words")
def perplexity_retention(d):
    """Exponents under counts of their tensor's even rows, exact and with four mantissa bits fewer values: perplexities of
    the odd rows and their ratio."""
    f = f"f AS (SELECT tensor, r % 2 AS odd, {d.shr('w', 7)} & 255 AS e, {d.shr('w', 9)} & 63 AS q FROM words)"
    parts = d.stacked("f", ["tensor", "odd"], [("'base'", long("e")), ("'coarse'", long("q * 4"))], ["kind", "sym"])
    c = f"k AS ({parts}), c AS (SELECT tensor, kind, sym, sum(1 - odd) AS train, sum(odd) AS held FROM k GROUP BY tensor, kind, sym), t AS (SELECT tensor, kind, held, train, sum(train) OVER (PARTITION BY tensor, kind) AS total FROM c), l AS (SELECT tensor, kind, exp(sum(held * -ln((train + 1.0) / (total + 256.0))) / sum(held)) AS ppl FROM t GROUP BY tensor, kind)"
    base, coarse = (f"max(CASE WHEN kind = '{k}' THEN ppl END)" for k in ("base", "coarse"))
    return f"{f}, {c}", f"SELECT tensor, {six(base)} AS base, {six(coarse)} AS coarse, {six(f'{base} / {coarse}')} AS retention FROM l GROUP BY tensor"


@definition("words")
def nibble_variants(d):
    """A tile of 4 x 64 words by its high twelve bits and low nibbles: as it is, one value, a palette of up to sixteen, one
    prefix with nibbles, or the commonest prefix with nibbles and the rest whole; the cheapest, in that order."""
    g = f"g AS (SELECT tensor, {d.div('r', 4)} AS tile, w, {d.shr('w', 4)} AS hi FROM words), wk AS (SELECT tensor, tile, count(DISTINCT w) AS kw, count(*) AS n FROM g GROUP BY tensor, tile), hc AS (SELECT tensor, tile, hi, count(*) AS n FROM g GROUP BY tensor, tile, hi), hk AS (SELECT tensor, tile, count(*) AS kh, max(n) AS top FROM hc GROUP BY tensor, tile)"
    ceil8 = lambda x: d.div(f"{x} + 7", 8)
    never = "999999999"
    rows = {"raw": "1 + 2 * n", "constant": f"CASE WHEN kw = 1 THEN 3 ELSE {never} END", "palette": f"CASE WHEN kw BETWEEN 2 AND 16 THEN 2 + 2 * kw + {ceil8('n * (' + bits_needed(d, 'kw') + ')')} ELSE {never} END", "high": f"CASE WHEN kh = 1 THEN 3 + {ceil8('4 * n')} ELSE {never} END", "mode_high": f"CASE WHEN 2 * top >= n THEN 3 + {ceil8('n')} + {ceil8('4 * top')} + 2 * (n - top) ELSE {never} END"}
    k = f"k AS (SELECT wk.tensor, wk.tile, wk.n, wk.kw, hk.kh, hk.top FROM wk JOIN hk ON wk.tensor = hk.tensor AND wk.tile = hk.tile), p AS ({d.stacked('k', ['tensor', 'tile'], [(long(i), repr(n), long(x)) for i, (n, x) in enumerate(rows.items())], ['id', 'variant', 'bytes'])})"
    return f"{g}, {k}", f"SELECT tensor, {long('tile')} AS tile, {long('min(bytes)')} AS bytes, {d.argmin('variant', 'bytes', 'id')} AS variant FROM p GROUP BY tensor, tile"


def _plane_savings(d):
    """CTE bodies ending in sv (tensor, tile, packed, saved): what a 16 x 16 tile of five-bit codes saves as planes of its
    XOR with the left neighbour, after a byte for its form."""
    g = f"g AS (SELECT tensor, {d.div('r', 16)} * 65536 + {d.div('c', 16)} AS tile, {d.shr('w', 7)} & 31 AS v, CASE WHEN c % 16 = 0 THEN 0 ELSE {d.shr('left_w', 7)} & 31 END AS l FROM words), x AS (SELECT tensor, tile, {d.xor('v', 'l')} AS res FROM g)"
    planes = " + ".join(f"CASE WHEN sum({d.shr('res', b)} & 1) = 0 THEN 1 ELSE 1 + {d.div('count(*) + 7', 8)} END" for b in range(5))
    return f"{g}, s AS (SELECT tensor, tile, {d.div('5 * count(*) + 7', 8)} AS packed, {planes} AS planes FROM x GROUP BY tensor, tile), sv AS (SELECT tensor, tile, packed, packed - planes - 1 AS saved FROM s)"


def _selected(d, least):
    """CTE bodies ending in se: the number of tiles, best savers first, that pays most after a map of them."""
    o = f"o AS (SELECT tensor, tile, packed, saved, row_number() OVER (PARTITION BY tensor ORDER BY saved DESC, tile) AS k, sum(packed) OVER (PARTITION BY tensor) AS whole, count(*) OVER (PARTITION BY tensor) AS tiles FROM sv), m AS (SELECT tensor, k, whole, tiles, saved >= {least} AS may, sum(saved) OVER (PARTITION BY tensor ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - least({d.div('tiles + 7', 8)}, 4 + 2 * k) AS net FROM o)"
    return f"{_plane_savings(d)}, {o}, se AS (SELECT tensor, max(whole) AS whole, max(tiles) AS tiles, coalesce(max(CASE WHEN may AND net > 0 THEN net END), 0) AS net, coalesce({d.argmin('CASE WHEN may AND net > 0 THEN k ELSE 0 END', 'CASE WHEN may AND net > 0 THEN -net ELSE 0 END', 'k')}, 0) AS kept FROM m GROUP BY tensor)"


@definition("words")
def selective_tiles(d):
    """Tiles are kept in planes where all of them, less the map of which they are, save most; else all stay packed."""
    return _selected(d, "1"), f"SELECT tensor, {long('tiles')} AS tiles, {long('kept')} AS kept, {long('whole')} AS packed_bytes, {long('whole - net')} AS bytes FROM se"


@definition("words")
def selective_margin(d):
    """The same where a tile has to save two bytes and a fiftieth of its packed bytes at least."""
    return _selected(d, f"greatest(2, {d.div('packed', 50)})"), f"SELECT tensor, {long('tiles')} AS tiles, {long('kept')} AS kept, {long('whole - net')} AS bytes FROM se"


@definition("words")
def mixed_bits(d):
    """Rows in 16, 8, 6 or 4 bits by the rank of their norm; a scale and zero point for each row. Largest error over the
    step, and complete bits."""
    n = "n AS (SELECT tensor, r, round(sum(x * x), 9) AS q, min(x) AS low, max(x) AS high FROM words GROUP BY tensor, r), k AS (SELECT tensor, r, low, high, row_number() OVER (PARTITION BY tensor ORDER BY q DESC, r) AS k, count(*) OVER (PARTITION BY tensor) AS n FROM n), b AS (SELECT tensor, r, low, high, CASE WHEN 20 * k <= n THEN 16 WHEN 4 * k <= n THEN 8 WHEN 2 * k <= n THEN 6 ELSE 4 END AS bits FROM k)"
    s = "s AS (SELECT tensor, r, bits, low, (high - low) / (POWER(2, bits) - 1) AS step FROM b WHERE high > low)"
    v = f"v AS (SELECT w.tensor, s.bits, CASE WHEN s.bits = 16 THEN 0 ELSE abs(w.x - (s.low + s.step * {d.rint('(w.x - s.low) / s.step')})) / s.step END AS err, w.r FROM words w JOIN s ON w.tensor = s.tensor AND w.r = s.r)"
    return f"{n}, {s}, {v}", f"SELECT tensor, {long('bits')} AS bits, {long('count(DISTINCT r)')} AS n_rows, {six('max(err)')} AS largest_error, {long('sum(bits) + count(DISTINCT r) * (8 + CASE WHEN bits = 16 THEN 0 ELSE 24 END)')} AS total_bits FROM v GROUP BY tensor, bits"


@definition("words")
def midrise_quant(d):
    """Each row in 2**b steps of its largest magnitude, values in the middle of a step; signal over noise in decibels."""
    a = "a AS (SELECT tensor, r, max(abs(x)) AS top FROM words GROUP BY tensor, r)"
    rows = [(long(b), f"(floor(least(greatest(w.x / a.top, -1), 0.999999999) * {1 << (b - 1)}) + 0.5) / {1 << (b - 1)} * a.top") for b in (3, 4, 6)]
    q = f"g AS (SELECT w.tensor, w.x, a.top FROM words w JOIN a ON w.tensor = a.tensor AND w.r = a.r WHERE a.top > 0), q AS ({d.stacked('g', ['tensor', 'x'], [(b, x.replace('w.x', 'x').replace('a.top', 'top')) for b, x in rows], ['bits', 'y'])})"
    return f"{a}, {q}", f"SELECT tensor, bits, {six('round(10 * log10(sum(x * x) / sum((x - y) * (x - y))), 4)')} AS sqnr, {six('max(abs(x - y))')} AS largest FROM q GROUP BY tensor, bits"


@definition("words")
def field_gap(d):
    """Where the bits of a word go: entropies of the fields, of the mantissa given the exponent, of the word, and the gaps."""
    f = f"f AS (SELECT tensor, w, {fields(d)} FROM words), c AS (SELECT tensor, w, s, e, m, count(*) AS n FROM f GROUP BY tensor, w, s, e, m)"
    h = lambda keys: f"SELECT tensor, sum(-n * 1.0 / t * log2(n * 1.0 / t)) AS h FROM (SELECT tensor, n, sum(n) OVER (PARTITION BY tensor) AS t FROM (SELECT tensor, {keys}, sum(n) AS n FROM c GROUP BY tensor, {keys}) a) b GROUP BY tensor"
    t = ", ".join(f"h_{n} AS ({h(k)})" for n, k in {"s": "s", "e": "e", "m": "m", "em": "e, m", "w": "w"}.items())
    return f"{f}, {t}", f"SELECT h_w.tensor, {six('h_s.h')} AS sign, {six('h_e.h')} AS exponent, {six('h_m.h')} AS mantissa, {six('h_em.h - h_e.h')} AS mantissa_given_exponent, {six('h_w.h')} AS word, {six('h_s.h + h_e.h + h_m.h - h_w.h')} AS gap FROM h_w JOIN h_s ON h_w.tensor = h_s.tensor JOIN h_e ON h_w.tensor = h_e.tensor JOIN h_m ON h_w.tensor = h_m.tensor JOIN h_em ON h_w.tensor = h_em.tensor"


@definition("words")
def projected_total(d):
    """Complete bytes of all tensors at the bits of each field alone."""
    f = f"f AS (SELECT tensor, {fields(d)} FROM words), k AS (SELECT tensor, count(*) AS n, count(DISTINCT e) AS ke, count(DISTINCT m) AS km FROM f GROUP BY tensor)"
    bits = f"(1 + ({bits_needed(d, 'ke')}) + ({bits_needed(d, 'km')}))"
    return f, f"SELECT coalesce(CAST(tensor AS BIGINT), -1) AS tensor, {long('sum(n)')} AS n_words, {long(f'sum({d.div(f'n * {bits} + 7', 8)} + 2 * ke)')} AS bytes, {six(bpw(f'sum({d.div(f'n * {bits} + 7', 8)} + 2 * ke)', 'sum(n)'))} AS bpw FROM k GROUP BY ROLLUP (tensor)"


@definition("words")
def field_code_sizes(d):
    """Bytes of a tensor's mantissas in one Huffman table, by the exponent where that has 256 words or more and pays for
    its table (others share the one table), and with the sign; a table takes two bytes and two a symbol."""
    f = f"f AS (SELECT tensor, {fields(d)} FROM words), ec AS (SELECT tensor, e, m, count(*) AS n FROM f GROUP BY tensor, e, m), mc AS (SELECT tensor, m, sum(n) AS n FROM ec GROUP BY tensor, m), sm AS (SELECT tensor, s * 128 + m AS sym, count(*) AS n FROM f GROUP BY tensor, s * 128 + m)"
    tables = f"{d.huffman('mc', ['tensor'], 'n', 'hm')}, {d.huffman('sm', ['tensor'], 'n', 'hs')}, {d.huffman('ec', ['tensor', 'e'], 'n', 'he')}"
    k = "mk AS (SELECT tensor, count(*) AS k, sum(n) AS n FROM mc GROUP BY tensor), sk AS (SELECT tensor, count(*) AS k FROM sm GROUP BY tensor), ek AS (SELECT tensor, e, count(*) AS k, sum(n) AS n FROM ec GROUP BY tensor, e)"
    share = "ct AS (SELECT ek.tensor, ek.e, ek.n, CASE WHEN ek.n >= 256 AND he.bits + 8 * (2 + 2 * ek.k) < ek.n * hm.bits * 1.0 / mk.n THEN 1 ELSE 0 END AS own, he.bits + 8 * (2 + 2 * ek.k) AS cost, ek.n * hm.bits * 1.0 / mk.n AS shared FROM ek JOIN he ON ek.tensor = he.tensor AND ek.e = he.e JOIN hm ON ek.tensor = hm.tensor JOIN mk ON ek.tensor = mk.tensor), cs AS (SELECT tensor, sum(own) AS contexts, sum(CASE WHEN own = 1 THEN cost ELSE shared END) AS bits FROM ct GROUP BY tensor)"
    byte = lambda x: d.div(f"{x} + 7", 8)
    return f"{f}, {tables}, {k}, {share}", f"SELECT mk.tensor, {long(f'2 + 2 * mk.k + {byte("hm.bits")}')} AS mantissa_bytes, {long(f'2 + 2 * sk.k + {byte("hs.bits")}')} AS sign_mantissa_bytes, {long('cs.contexts')} AS contexts, {six('(cs.bits + 8 * (2 + 2 * mk.k)) / mk.n')} AS bits_by_exponent FROM mk JOIN hm ON mk.tensor = hm.tensor JOIN sk ON mk.tensor = sk.tensor JOIN hs ON mk.tensor = hs.tensor JOIN cs ON mk.tensor = cs.tensor"


@definition("words")
def node_formulas(d):
    """Nibbles of 16 x 16 tiles by seven formulas: one value, the tile to the left, a value a row, a value a column, a plane
    a + bx + cy modulo 16, the commonest with exceptions, or as they are; the cheapest, in that order."""
    v = lambda x: f"({d.shr(x, 3)} & 15)"
    g = f"h AS (SELECT tensor, max(r) + 1 AS h FROM words GROUP BY tensor), g AS (SELECT w.tensor, {d.div('w.r', 16)} AS ty, {d.div('w.c', 16)} AS tx, w.r % 16 AS y, w.c % 16 AS x, {v('w.w')} AS v FROM words w JOIN h ON w.tensor = h.tensor WHERE w.r < {d.div('h.h', 16)} * 16)"
    corner = "c AS (SELECT tensor, ty, tx, max(CASE WHEN y = 0 AND x = 0 THEN v END) AS a, max(CASE WHEN y = 0 AND x = 1 THEN v END) AS b, max(CASE WHEN y = 1 AND x = 0 THEN v END) AS e FROM g GROUP BY tensor, ty, tx)"
    seen = "n AS (SELECT g.tensor, g.ty, g.tx, g.y, g.x, g.v, lag(g.v) OVER (PARTITION BY g.tensor, g.ty, g.y, g.x ORDER BY g.tx) AS l, min(g.v) OVER (PARTITION BY g.tensor, g.ty, g.tx, g.y) AS rl, min(g.v) OVER (PARTITION BY g.tensor, g.ty, g.tx, g.x) AS cl, (c.a + g.x * (c.b - c.a + 16) + g.y * (c.e - c.a + 16)) % 16 AS p FROM g JOIN c ON g.tensor = c.tensor AND g.ty = c.ty AND g.tx = c.tx)"
    odd = lambda when: f"sum(CASE WHEN {when} THEN 0 ELSE 1 END)"
    sums = f"t AS (SELECT tensor, ty, tx, count(*) AS n, {odd('l = v')} AS ol, {odd('rl = v')} AS orow, {odd('cl = v')} AS ocol, {odd('p = v')} AS op FROM n GROUP BY tensor, ty, tx), k AS (SELECT tensor, ty, tx, v, count(*) AS m FROM g GROUP BY tensor, ty, tx, v), m AS (SELECT tensor, ty, tx, count(*) AS kinds, max(m) AS top FROM k GROUP BY tensor, ty, tx)"
    never = "999999"
    rows = {"constant": f"CASE WHEN kinds = 1 THEN 2 ELSE {never} END", "inherit": f"CASE WHEN ol = 0 THEN 1 ELSE {never} END", "row": f"CASE WHEN orow = 0 THEN 9 ELSE {never} END", "column": f"CASE WHEN ocol = 0 THEN 9 ELSE {never} END", "plane": f"CASE WHEN op = 0 THEN 3 ELSE {never} END", "exceptions": f"3 + {d.div('3 * (n - top) + 1', 2)}", "raw": "129"}
    priced = d.stacked("j", ["tensor", "ty", "tx"], [(long(i), repr(name), long(x)) for i, (name, x) in enumerate(rows.items())], ["id", "formula", "bytes"])
    return f"{g}, {corner}, {seen}, {sums}, j AS (SELECT t.tensor, t.ty, t.tx, t.n, t.ol, t.orow, t.ocol, t.op, m.kinds, m.top FROM t JOIN m ON t.tensor = m.tensor AND t.ty = m.ty AND t.tx = m.tx), q AS ({priced})", f"SELECT tensor, {long('ty')} AS ty, {long('tx')} AS tx, {long('min(bytes)')} AS bytes, {d.argmin('formula', 'bytes', 'id')} AS formula FROM q GROUP BY tensor, ty, tx"


@definition("words")
def nested_tiers(d):
    """Six mantissa bits in three nested stages of two: error that is left after each, as a share of the energy, and what
    each stage adds in bytes."""
    f = f"f AS (SELECT tensor, {fields(d)}, w, x FROM words)"
    cut = lambda k: d.shl(d.shr("m", 7 - k), 7 - k)
    stacked = d.stacked("f", ["tensor", "m"], [(long(k), long(cut(k))) for k in (2, 4, 6)], ["bits", "back"])
    return f"{f}, s AS ({stacked})", f"SELECT tensor, bits, {long(d.div('2 * count(*) + 7', 8))} AS stage_bytes, {six('sum((m - back) * (m - back)) * 1.0 / sum(m * m + 1)')} AS left_share FROM s GROUP BY tensor, bits"
