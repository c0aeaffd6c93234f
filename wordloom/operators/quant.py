"""Quantisers, nearest codewords, and the pieces of a forward pass."""

from __future__ import annotations

from wordloom.operators.fields import fields, keep_k, names
from wordloom.plans.dialect import definition, long, six

# Parts of names, in order of preference.
PREFERRED = "(1, 'q_proj'), (2, 'down_proj'), (3, 'embed'), (4, 'conv')"


def groups(d):
    return f"g AS (SELECT tensor, r, c, {d.div('c', 32)} AS g, x FROM words), a AS (SELECT tensor, r, g, max(abs(x)) AS top, min(x) AS low, max(x) AS high FROM g GROUP BY tensor, r, g)"


@definition("words")
def int4_group(d):
    """Four bits by groups: scale is the largest magnitude over 7; codes from -8 to 7, half to even."""
    q = f"q AS (SELECT g.tensor, g.x, greatest(a.top / 7, 1e-8) AS s, greatest(least({d.rint('g.x / greatest(a.top / 7, 1e-8)')}, 7), -8) AS q FROM g JOIN a ON g.tensor = a.tensor AND g.r = a.r AND g.g = a.g)"
    return f"{groups(d)}, {q}", f"SELECT {long('q')} AS code, {long('count(*)')} AS n, {six('avg(abs(x - q * s))')} AS mae FROM q GROUP BY q"


@definition("words")
def minmax_quant(d):
    q = f"q AS (SELECT g.tensor, g.x, a.low, (a.high - a.low) / 15 AS s, {d.rint('(g.x - a.low) / ((a.high - a.low) / 15)')} AS q FROM g JOIN a ON g.tensor = a.tensor AND g.r = a.r AND g.g = a.g WHERE a.high > a.low)"
    return f"{groups(d)}, {q}", f"SELECT tensor, {long('sum(q)')} AS code_sum, {six('10 * log10(sum(x * x) / sum((x - (low + q * s)) * (x - (low + q * s))))')} AS sqnr FROM q GROUP BY tensor"


@definition("words")
def scale_pick(d):
    """Of six scales, those within 2 % of the least error; the smallest sum of code steps along the row decides."""
    f = "f AS " + d.values("(0, 0.88), (1, 0.94), (2, 1.0), (3, 1.06), (4, 1.12), (5, 1.25)", "cand", "factor")
    q = f"q AS (SELECT g.tensor, g.r, g.g, g.c, f.cand, g.x, CAST(f.factor AS DOUBLE) * a.top / 15 AS s, greatest(least({d.rint('g.x / (CAST(f.factor AS DOUBLE) * a.top / 15)')}, 15), -15) AS q FROM g JOIN a ON g.tensor = a.tensor AND g.r = a.r AND g.g = a.g CROSS JOIN f WHERE a.top > 0)"
    e = "e AS (SELECT tensor, r, g, cand, round(avg((x - q * s) * (x - q * s)), 12) AS mse, sum(abs(q - p)) AS steps FROM (SELECT q.*, coalesce(lag(q) OVER (PARTITION BY tensor, r, g, cand ORDER BY c), q) AS p FROM q) z GROUP BY tensor, r, g, cand), m AS (SELECT *, min(mse) OVER (PARTITION BY tensor, r, g) AS best FROM e)"
    return f"{groups(d)}, {f}, {q}, {e}, k AS (SELECT tensor, r, g, {d.argmin('cand', 'steps', 'mse', 'cand')} AS cand FROM m WHERE mse <= 1.02 * best GROUP BY tensor, r, g)", f"SELECT {long('cand')} AS cand, {long('count(*)')} AS n FROM k GROUP BY cand"


def codebook(d, k=16):
    return f"v AS (SELECT vec_id, r * 64 + c AS place, c, x FROM words), b AS (SELECT vec_id AS code, c, x FROM v WHERE vec_id < {k})"


def assigned(d):
    return f"{codebook(d)}, ds AS (SELECT v.vec_id, b.code, round(sum((v.x - b.x) * (v.x - b.x)), 9) AS dist FROM v JOIN b ON v.c = b.c GROUP BY v.vec_id, b.code), n AS (SELECT vec_id, {d.argmin('code', 'dist', 'code')} AS code, min(dist) AS dist FROM ds GROUP BY vec_id)"


@definition("words")
def nearest_codeword(d):
    return assigned(d), f"SELECT vec_id, {long('code')} AS code, {six('dist')} AS distance FROM n"


@definition("words")
def kmeans_step(d):
    return assigned(d), f"SELECT {long('n.code')} AS code, v.c, {six('avg(v.x)')} AS centre, {long('count(*)')} AS members FROM n JOIN v ON n.vec_id = v.vec_id GROUP BY n.code, v.c"


@definition("words")
def hamming_palette(d):
    """Exponents to the nearest of the eight commonest by differing bits; ties to the commoner."""
    k = f"e AS (SELECT tensor, {d.shr('w', 7)} & 255 AS e FROM words), k AS (SELECT e, count(*) AS n FROM e GROUP BY e), p AS (SELECT e AS p, row_number() OVER (ORDER BY n DESC, e) - 1 AS i FROM (SELECT * FROM k ORDER BY n DESC, e LIMIT 8) z)"
    ones = d.pop(d.xor("k.e", "p.p"))
    return f"{k}, x AS (SELECT k.e, k.n, p.i, {ones} AS far FROM k CROSS JOIN p), b AS (SELECT e, max(n) AS n, {d.argmin('i', 'far', 'i')} AS i, min(far) AS far FROM x GROUP BY e)", f"SELECT {long('e')} AS e, {long('n')} AS n, {long('i')} AS palette, {long('far')} AS bits FROM b"


@definition("words")
def gram_matrix(d):
    """Second moments of the columns, by self-join on the row."""
    return "n AS (SELECT count(DISTINCT vec_id) AS n FROM words)", f"SELECT a.c AS i, b.c AS j, {six('sum(a.x * b.x) / max(n.n)')} AS h FROM words a JOIN words b ON a.vec_id = b.vec_id CROSS JOIN n GROUP BY a.c, b.c"


@definition("words")
def hadamard_rotation(d):
    """Rows times the 64 x 64 Hadamard matrix over 8; norms stay."""
    j = f"j AS (SELECT i AS j FROM {d.numbers(64)} z)"
    sign = f"(1 - 2 * ({d.pop('w.c & j.j')} % 2))"
    return f"{j}, y AS (SELECT w.tensor, w.r, j.j, sum(w.x * {sign}) / 8 AS y FROM words w CROSS JOIN j GROUP BY w.tensor, w.r, j.j)", f"SELECT tensor, {six('sum(y * y)')} AS energy, {six('max(abs(y))')} AS peak FROM y GROUP BY tensor"


@definition("words")
def dequantised(d):
    """Codes of six bits with a zero point, back to values and rounded to 16-bit exponent steps."""
    q = f"q AS (SELECT g.tensor, g.x, (a.high - a.low) / 62 AS s, {d.rint('-a.low / ((a.high - a.low) / 62)')} AS z, {d.rint('(g.x - a.low) / ((a.high - a.low) / 62)')} AS q FROM g JOIN a ON g.tensor = a.tensor AND g.r = a.r AND g.g = a.g WHERE a.high > a.low)"
    return f"{groups(d)}, {q}", f"SELECT tensor, {six('max(abs(x - (q - z) * s))')} AS max_error, {six('avg((q - z) * s)')} AS mean_value, {long('count(*)')} AS n FROM q GROUP BY tensor"


@definition("words")
def rmsnorm_silu(d):
    n = "n AS (SELECT tensor, r, sqrt(avg(x * x) + 1e-6) AS rms FROM words GROUP BY tensor, r), y AS (SELECT w.tensor, w.x / n.rms AS y FROM words w JOIN n ON w.tensor = n.tensor AND w.r = n.r)"
    return n, f"SELECT tensor, {six('sum(y * y)')} AS energy, {six('sum(y / (1 + exp(-y)))')} AS silu FROM y GROUP BY tensor"


@definition("words")
def causal_attention(d):
    """The rows of each tensor as queries, keys and values, in stretches of eight: softmax over the rows of the stretch up
    to each."""
    s = f"q AS (SELECT tensor, r, c, x, {d.div('r', 8)} AS b FROM words), s AS (SELECT a.tensor, a.r AS t, b.r AS s, sum(a.x * b.x) / 8 AS z FROM q a JOIN q b ON a.tensor = b.tensor AND a.b = b.b AND a.c = b.c AND b.r <= a.r GROUP BY a.tensor, a.r, b.r), p AS (SELECT tensor, t, s, exp(z - max(z) OVER (PARTITION BY tensor, t)) AS p FROM s), n AS (SELECT tensor, t, s, p / sum(p) OVER (PARTITION BY tensor, t) AS p FROM p)"
    return s, f"SELECT n.tensor, n.t, {six('sum(n.p * q.x)')} AS value_sum, {six('sum(n.p * q.x * q.c)')} AS checksum FROM n JOIN q ON n.tensor = q.tensor AND n.s = q.r GROUP BY n.tensor, n.t"


@definition("words")
def utility_ranking(d):
    """Bytes saved over the error that dropping two mantissa bits adds, by tensor."""
    u = "u AS (SELECT tensor, count(*) * 2 / 8.0 AS saved, round(sum(x * x) / 4096, 9) AS harm FROM words GROUP BY tensor)"
    return u, f"SELECT tensor, {six('saved / harm')} AS utility, {long('row_number() OVER (ORDER BY saved / harm DESC, tensor)')} AS place FROM u"


@definition("words")
def row_keep_map(d):
    """Rows keep six, four or three mantissa bits by the rank of their norm; words after that, and bytes saved."""
    n = f"n AS (SELECT tensor, r, round(sum(x * x), 9) AS q FROM words GROUP BY tensor, r), k AS (SELECT tensor, r, row_number() OVER (PARTITION BY tensor ORDER BY q DESC, r) AS k, count(*) OVER (PARTITION BY tensor) AS n FROM n), m AS (SELECT tensor, r, CASE WHEN 10 * k <= n THEN 6 WHEN 2 * k <= n THEN 4 ELSE 3 END AS keep FROM k)"
    f = f"f AS (SELECT w.tensor, m.keep, w.w, {fields(d, 'w.w')} FROM words w JOIN m ON w.tensor = m.tensor AND w.r = m.r)"
    kept = f"CASE keep WHEN 6 THEN {keep_k(d, 6)} WHEN 4 THEN {keep_k(d, 4)} ELSE {keep_k(d, 3)} END"
    return f"{n}, {f}", f"SELECT tensor, {long('keep')} AS keep, {long('count(*)')} AS n_words, {long(f'sum({kept})')} AS word_sum, {six('sum(7 - keep) / 8.0')} AS saved_bytes FROM f GROUP BY tensor, keep"


@definition("words")
def tile_scatter(d):
    """Words gathered into 8 x 8 tiles by place in the tile, and scattered back to where they stood."""
    g = f"g AS (SELECT tensor, {d.div('r', 8)} * 8 + {d.div('c', 8)} AS tile, (r % 8) * 8 + c % 8 AS place, w FROM words), b AS (SELECT tensor, {d.div('tile', 8)} * 8 + {d.div('place', 8)} AS r, tile % 8 * 8 + place % 8 AS c, w FROM g)"
    return g, f"SELECT a.tensor, {long('count(*)')} AS n_words, {long('sum(CASE WHEN a.w <> b.w THEN 1 ELSE 0 END)')} AS differing FROM words a JOIN b ON a.tensor = b.tensor AND a.r = b.r AND a.c = b.c GROUP BY a.tensor"


@definition()
def preferred_tensors(d):
    """The first name of each preferred kind, or the first of all where a kind has none."""
    p = f"p AS {d.values(PREFERRED, 'place', 'part')}, n AS (SELECT name FROM {names(d)} z), k AS (SELECT p.place, p.part, n.name, row_number() OVER (PARTITION BY p.place ORDER BY CASE WHEN n.name LIKE concat('%', p.part, '%') THEN 0 ELSE 1 END, n.name) AS nth FROM p CROSS JOIN n)"
    return p, f"SELECT {long('place')} AS place, part, name FROM k WHERE nth = 1"
