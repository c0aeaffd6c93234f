"""Histograms, entropies, coverage, pair statistics, held-out models and quality measures."""

from __future__ import annotations

from wordloom.operators.fields import bpw, fields, keep_k
from wordloom.operators.windows import counted
from wordloom.plans.dialect import definition, long, six


def entropy(n, total):
    """Terms of Shannon entropy in bits, to be summed."""
    return f"-({n} * 1.0 / {total}) * log2({n} * 1.0 / {total})"


def entropies(d, source, symbols, keys="tensor"):
    """CTE body: entropy, distinct symbols, largest count and total of each named symbol column, by keys. Each symbol
    is counted with partial aggregation; totals come from the counts, not from another pass."""
    parts = d.stacked(source, keys.split(", "), [(f"'{name}'", long(x)) for name, x in symbols.items()], ["field", "sym"])
    return f"""en_s AS ({parts}), en_c AS (SELECT {keys}, field, sym, count(*) AS n FROM en_s GROUP BY {keys}, field, sym),
en_t AS (SELECT {keys}, field, sym, n, sum(n) OVER (PARTITION BY {keys}, field) AS total FROM en_c),
en AS (SELECT {keys}, field, sum({entropy('n', 'total')}) AS h, count(*) AS k, max(n) AS top, max(total) AS total FROM en_t GROUP BY {keys}, field)"""


@definition("words")
def field_entropy(d):
    return f"f AS (SELECT tensor, w, {fields(d)} FROM words), {entropies(d, 'f', {'word': 'w', 'sign': 's', 'exponent': 'e', 'mantissa': 'm'})}", f"SELECT tensor, field, {six('h')} AS bits, {long('k')} AS distinct_symbols, {six('top * 1.0 / total')} AS top1 FROM en"


@definition("words")
def residual_entropy(d):
    x = f"x AS (SELECT tensor, {d.xor('w', 'coalesce(prev_w, 0)')} AS pv, {d.xor('w', 'coalesce(up_w, 0)')} AS pr FROM words), {entropies(d, 'x', {'prev_value': 'pv', 'prev_row': 'pr'})}"
    return x, f"SELECT tensor, field, {six('h')} AS bits, {long('k')} AS distinct_symbols FROM en"


@definition("words")
def high_entropy(d):
    x = f"x AS (SELECT tensor, w, {d.xor('w', 'coalesce(prev_w, 0)')} AS pv FROM words), {entropies(d, 'x', {'word': 'w', 'residual': 'pv'})}"
    return x, f"SELECT tensor, min(CASE WHEN field = 'word' THEN h END) >= 15.5 AND min(CASE WHEN field = 'residual' THEN h END) >= 15.0 AS high FROM en GROUP BY tensor"


@definition("words")
def coverage_top4(d):
    k = f"k AS ({counted('words', 'tensor', 'w')}), o AS (SELECT tensor, sym, n, row_number() OVER (PARTITION BY tensor ORDER BY n DESC, sym) AS nth, sum(n) OVER (PARTITION BY tensor) AS total FROM k)"
    return k, f"SELECT tensor, {long('max(nth)')} AS distinct_words, {six('sum(CASE WHEN nth <= 4 THEN n ELSE 0 END) * 1.0 / max(total)')} AS top4, {long('max(CASE WHEN nth = 1 THEN sym END)')} AS mode FROM o GROUP BY tensor"


@definition("words")
def exponent_histogram(d):
    e = f"e AS (SELECT tensor, {d.shr('w', 7)} & 255 AS e FROM words), k AS (SELECT e, count(*) AS n FROM e GROUP BY e)"
    return e, f"SELECT {long('z.i')} AS e, {long('coalesce(k.n, 0)')} AS n FROM {d.numbers(256)} z LEFT JOIN k ON k.e = z.i"


@definition("words")
def default_residual_stats(d):
    x = f"x AS (SELECT tensor, {d.xor('w', 'coalesce(up_w, 0)')} AS res FROM words), k AS ({counted('x', 'tensor', 'res')}), o AS (SELECT tensor, sym, n, row_number() OVER (PARTITION BY tensor ORDER BY n DESC, sym) AS nth FROM k)"
    ones = d.pop("sym")
    return x, f"SELECT tensor, {six('sum(CASE WHEN sym = 0 THEN n ELSE 0 END) * 1.0 / sum(n)')} AS zero_rate, {long('count(*)')} AS distinct_res, {six('sum(CASE WHEN nth <= 4 THEN n ELSE 0 END) * 1.0 / sum(n)')} AS top4, {six(f'sum({ones} * n) * 1.0 / sum(n)')} AS mean_ones, {long('max(CASE WHEN nth = 1 THEN sym END)')} AS default_res FROM o GROUP BY tensor"


def pair(d, keep=4):
    """Base words and a target of fewer mantissa bits, at the same places."""
    return f"f AS (SELECT tensor, r, c, w, {fields(d)} FROM words), p AS (SELECT tensor, r, c, w AS base, {keep_k(d, keep)} AS target FROM f)"


@definition("words")
def xor_stats(d):
    x = f"{pair(d)}, x AS (SELECT tensor, base, target, {d.xor('base', 'target')} AS res FROM p), {entropies(d, 'x', {'word': 'res', 'exponent': d.shr('res', 7) + ' & 255', 'mantissa': 'res & 127'})}, t AS (SELECT tensor, count(*) AS n, sum(CASE WHEN res = 0 THEN 1 ELSE 0 END) AS same, avg({d.pop('res')}) AS ones FROM x GROUP BY tensor)"
    return x, f"SELECT t.tensor, en.field, {long('t.same')} AS unchanged, {six('t.ones')} AS hamming, {six('en.h')} AS bits FROM t JOIN en ON t.tensor = en.tensor"


@definition("words")
def weighted_means(d):
    x = f"f AS (SELECT tensor, {fields(d)} FROM words), {entropies(d, 'f', {'exponent': 'e', 'mantissa': 'm'})}"
    return x, f"SELECT field, {six('sum(h * total) / sum(total)')} AS bits, {long('sum(total)')} AS n FROM en GROUP BY field"


@definition("words")
def tile_repetition(d):
    ones = d.pop(d.xor("w", "ref"))
    x = f"x AS (SELECT tensor, {d.div('r', 4)} AS tile, w, lag(w) OVER (PARTITION BY tensor, r % 4, c ORDER BY r) AS ref FROM words), y AS (SELECT tensor, tile, avg({ones}) AS ones, {d.joined(d.hexbyte(d.shr('w', 8)), 'w')} AS content FROM x GROUP BY tensor, tile)"
    return x, f"SELECT tensor, {long('count(*)')} AS tiles, {six('1.0 - count(DISTINCT content) * 1.0 / count(*)')} AS duplicate_rate, {six('avg(ones)')} AS mean_ones FROM y GROUP BY tensor"


@definition("words")
def cross_tensor_duplicates(d):
    e = d.shr("w", 7)
    t = f"t AS (SELECT tensor, r * 32 + {d.div('c', 2)} AS tile, max(CASE WHEN c % 2 = 0 THEN {e} END) * 512 + max(CASE WHEN c % 2 = 1 THEN {e} END) AS content FROM words GROUP BY tensor, r * 32 + {d.div('c', 2)}), k AS (SELECT content, count(*) AS n, count(DISTINCT tensor) AS tensors FROM t GROUP BY content)"
    return t, f"SELECT {long('tensors')} AS tensors, {long('count(*)')} AS contents, {long('sum(n)')} AS tiles FROM k GROUP BY tensors"


@definition("words")
def spatial_win(d):
    """Share of 4 x 64 tiles whose exponents cost fewer ideal bits after XOR with the word above."""
    x = f"x AS (SELECT tensor, {d.div('r', 4)} AS tile, {d.shr('w', 7)} & 255 AS e, CASE WHEN r % 4 = 0 THEN {d.shr('w', 7)} & 255 ELSE {d.xor(d.shr('w', 7) + ' & 255', d.shr('up_w', 7) + ' & 255')} END AS res FROM words), {entropies(d, 'x', {'plain': 'e', 'spatial': 'res'}, 'tensor, tile')}"
    y = "y AS (SELECT tensor, tile, max(CASE WHEN field = 'plain' THEN h END) AS a, max(CASE WHEN field = 'spatial' THEN h END) AS b FROM en GROUP BY tensor, tile)"
    return f"{x}, {y}", f"SELECT tensor, {long('count(*)')} AS tiles, {six('avg(CASE WHEN round(b, 9) < round(a, 9) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)')} AS win_share, {six('avg(a - b)')} AS mean_gain FROM y GROUP BY tensor"


@definition("words")
def group_percentiles(d):
    g = f"{d.div('c', 32)}"
    return "", f"SELECT tensor, {long(g)} AS g, {six('min(x)')} AS low, {six('max(x)')} AS high, {six('max(abs(x))')} AS absmax, {six(d.percentile('x', 0.01))} AS p01, {six(d.percentile('x', 0.99))} AS p99 FROM words GROUP BY tensor, {g}"


def split(d):
    return f"n AS (SELECT tensor, max(r) + 1 AS n FROM words GROUP BY tensor), h AS (SELECT tensor, n - least(greatest(1, CAST({d.rint('n * 0.2')} AS BIGINT)), n - 1) AS cut FROM n), f AS (SELECT w.tensor, w.r, w.c, w.r >= h.cut AS held, {fields(d, 'w.w')}, {d.shr('w.left_w', 7)} & 255 AS pe, w.left_w & 127 AS pm FROM words w JOIN h ON w.tensor = h.tensor)"


def nll(ctx, symbol, alphabet):
    """CTE bodies: held-out bits of a symbol given a context, with one count more for each symbol."""
    return f"""c2 AS (SELECT {ctx} AS ctx, {symbol} AS y, count(*) AS n FROM f WHERE NOT held GROUP BY {ctx}, {symbol}), c1 AS (SELECT ctx, sum(n) AS n FROM c2 GROUP BY ctx),
q2 AS (SELECT {ctx} AS ctx, {symbol} AS y, count(*) AS n FROM f WHERE held GROUP BY {ctx}, {symbol}),
nl AS (SELECT q2.ctx, q2.n, -log2((coalesce(c2.n, 0) + 1.0) / (coalesce(c1.n, 0) + {alphabet})) AS bits FROM q2 LEFT JOIN c2 ON q2.ctx = c2.ctx AND q2.y = c2.y LEFT JOIN c1 ON q2.ctx = c1.ctx)"""


def held_out(name, ctx, symbol="m", alphabet=128):
    def query(d):
        return f"{split(d)}, {nll(ctx, symbol, alphabet)}", f"SELECT '{name}' AS model, {long('sum(n)')} AS n_hold, {six('sum(n * bits) / sum(n)')} AS bits, {long('count(DISTINCT ctx)')} AS contexts FROM nl"

    query.__name__ = name
    definition("words")(query)


held_out("holdout_nll", "m * 0")
held_out("holdout_nll_exponent", "e")
held_out("holdout_nll_previous_exponent", "coalesce(pe, 0)")
held_out("holdout_nll_sign_exponent", "s * 256 + e")
held_out("holdout_exponent_chain", "coalesce(pe, 0)", "e", 256)
held_out("holdout_hashed_context", "((coalesce(pm, 0) * 131 + e) & 511)")


@definition("words")
def method_ranking(d):
    models = {"global": "0", "exponent": "e", "sign_exponent": "s * 256 + e"}
    train = d.stacked("f", ["m AS y", "held"], [(f"'{n}'", long(x)) for n, x in models.items()], ["model", "ctx"]).replace("SELECT m AS y, held, st", "SELECT y, held, st")
    a = f"{split(d)}, a AS ({train}), c2 AS (SELECT model, ctx, y, count(*) AS n FROM a WHERE NOT held GROUP BY model, ctx, y), c1 AS (SELECT model, ctx, sum(n) AS n FROM c2 GROUP BY model, ctx), q2 AS (SELECT model, ctx, y, count(*) AS n FROM a WHERE held GROUP BY model, ctx, y)"
    b = "b AS (SELECT q2.model, sum(q2.n * -log2((coalesce(c2.n, 0) + 1.0) / (coalesce(c1.n, 0) + 128))) / sum(q2.n) AS bits FROM q2 LEFT JOIN c2 ON q2.model = c2.model AND q2.ctx = c2.ctx AND q2.y = c2.y LEFT JOIN c1 ON q2.model = c1.model AND q2.ctx = c1.ctx GROUP BY q2.model)"
    return f"{a}, {b}", f"SELECT model, {six('bits')} AS bits, {long('rank() OVER (ORDER BY bits)')} AS place FROM b"


@definition("words")
def bit_markov_nll(d):
    """Bits of the mantissa by plane, given the two higher bits: Krichevsky-Trofimov estimates."""
    parts = d.stacked("f", ["held"], [(long(b), long(f"{d.shr('m', b)} & 1"), long(f"{d.shr('m', b + 1)} & 3")) for b in range(6, -1, -1)], ["plane", "bit", "ctx"])
    k = f"{split(d)}, a AS ({parts}), t AS (SELECT plane, ctx, sum(bit) AS ones, count(*) AS n FROM a WHERE NOT held GROUP BY plane, ctx), q AS (SELECT plane, ctx, bit, count(*) AS n FROM a WHERE held GROUP BY plane, ctx, bit)"
    p1 = "(coalesce(t.ones, 0) + 0.5) / (coalesce(t.n, 0) + 1.0)"
    return k, f"SELECT {long('q.plane')} AS plane, {six(f'sum(q.n * -log2(CASE WHEN q.bit = 1 THEN {p1} ELSE 1 - {p1} END)) / sum(q.n)')} AS bits FROM q LEFT JOIN t ON q.plane = t.plane AND q.ctx = t.ctx GROUP BY q.plane"


@definition("words")
def context_rule_hits(d):
    f = f"f AS (SELECT tensor, {d.shr('w', 7)} & 127 AS e, w & 127 AS m, coalesce(prev_w, 0) & 127 AS p, (r * 64 + c) % 256 AS pos FROM words)"
    rules = {"copy": "p", "position": "pos & 127", "next": "(p + 1) & 127", "exponent": "e", "mixed": f"{d.xor(d.xor('p', 'e'), 'pos')} & 127", "mean": f"{d.shr('(p + e)', 1)} & 127"}
    parts = d.stacked("f", ["tensor"], [(long(i), long(f"CASE WHEN ({x}) = m THEN 1 ELSE 0 END")) for i, x in enumerate(rules.values())], ["rule", "hit"])
    return f"{f}, a AS ({parts}), s AS (SELECT tensor, rule, sum(hit) AS hits, count(*) AS n FROM a GROUP BY tensor, rule)", f"SELECT tensor, {long(d.argmin('rule', '-hits', 'rule'))} AS rule, {long('max(hits)')} AS hits, {long('max(n)')} AS n FROM s GROUP BY tensor"


@definition("words")
def quality_ladder(d):
    """Error of keeping k mantissa bits, by tensor, from word differences of equal sign and near exponents."""
    v = lambda w: f"((1 - 2 * {d.shr(w, 15)}) * (128 + ({w} & 127)) * POWER(2.0, ({d.shr(w, 7)} & 255) - 134))"
    parts = d.stacked("f", ["tensor", "w"], [(long(k), long(keep_k(d, k))) for k in (2, 4, 6)], ["keep", "kept"])
    return f"f AS (SELECT tensor, w, {fields(d)} FROM words), k AS ({parts}), v AS (SELECT tensor, keep, {v('w')} AS a, {v('kept')} AS b FROM k)", f"SELECT tensor, {long('keep')} AS keep, {six('max(abs(a - b))')} AS max_abs, {six('avg(abs(a - b))')} AS mae, {six('10 * log10(sum(a * a) / sum((a - b) * (a - b)))')} AS sqnr FROM v GROUP BY tensor, keep"


@definition("words")
def softmax_kl(d):
    """Rows of values as logits, against the same at half precision of place: KL, and whether the largest agrees."""
    a = "a AS (SELECT tensor, r, c, x AS p, round(x * 16) / 16 AS q FROM words), b AS (SELECT *, exp(p - max(p) OVER (PARTITION BY tensor, r)) AS ep, exp(q - max(q) OVER (PARTITION BY tensor, r)) AS eq FROM a), s AS (SELECT tensor, r, c, ep / sum(ep) OVER (PARTITION BY tensor, r) AS p, eq / sum(eq) OVER (PARTITION BY tensor, r) AS q FROM b)"
    k = f"k AS (SELECT tensor, r, sum(p * ln((p + 1e-12) / (q + 1e-12))) AS kl, {d.argmin('c', '-p', 'c')} AS top_p, {d.argmin('c', '-q', 'c')} AS top_q FROM s GROUP BY tensor, r)"
    return f"{a}, {k}", f"SELECT tensor, {six('avg(kl)')} AS kl, {six('avg(CASE WHEN top_p = top_q THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)')} AS agreement FROM k GROUP BY tensor"


@definition("words")
def gram_diagonal(d):
    return "", f"SELECT c, {six('avg(x * x)')} AS importance FROM words GROUP BY c"


@definition("words")
def channel_importance(d):
    n = f"n AS (SELECT tensor, r, sqrt(sum(x * x) + 1e-12) AS l2 FROM words GROUP BY tensor, r), m AS (SELECT tensor, {d.median('l2')} AS med FROM n GROUP BY tensor)"
    return n, f"SELECT n.tensor, {long(d.div('n.r', 16))} AS unit, {six('avg(n.l2 / m.med)')} AS importance, {long('count(*)')} AS n_rows FROM n JOIN m ON n.tensor = m.tensor GROUP BY n.tensor, {d.div('n.r', 16)}"


@definition("documents")
def token_counts(d):
    return f"t AS (SELECT {d.explode_words('text')} AS tok FROM documents), n AS (SELECT tok, count(*) AS n FROM t GROUP BY tok)", f"SELECT {long('n')} AS times, {long('count(*)')} AS tokens FROM n GROUP BY n"


@definition("words")
def embedding_inventory(d):
    n = "n AS (SELECT tensor, r, sqrt(sum(x * x)) AS norm, max(abs(x)) AS peak FROM words GROUP BY tensor, r)"
    return n, f"SELECT tensor, {long('count(*)')} AS n_rows, {six('avg(norm)')} AS mean_norm, {six('max(norm)')} AS max_norm, {long('sum(CASE WHEN norm < 0.5 THEN 1 ELSE 0 END)')} AS padded FROM n GROUP BY tensor"


@definition("words")
def bytes_saved(d):
    p = "p AS (SELECT tensor, 3 + tensor % 5 AS keep, count(*) AS n FROM words GROUP BY tensor)"
    return p, f"SELECT tensor, {long('keep')} AS keep, {six('(7 - keep) * n / 8.0')} AS saved_bytes, {six(bpw('n * 2 - (7 - keep) * n / 8.0', 'n'))} AS bpw FROM p"


@definition("words")
def kept_entropy(d):
    parts = ", ".join(f"{d.shr('m', 7 - k)} AS k{k}" for k in (2, 3, 4, 5, 6))
    return f"f AS (SELECT tensor, w & 127 AS m FROM words), g AS (SELECT tensor, {parts} FROM f), {entropies(d, 'g', {f'keep_{k}': f'k{k}' for k in (2, 3, 4, 5, 6)})}", f"SELECT tensor, field, {six('h')} AS bits FROM en"


@definition("words")
def entropy_bounds(d):
    """Complete bytes if exponents cost their entropy and the rest a byte."""
    exponent = "max(CASE WHEN field = 'exponent' THEN h * total / 8 + total END)"
    return f"f AS (SELECT tensor, w, {fields(d)}, {d.shr('w', 15)} * 128 + (w & 127) AS sm FROM words), {entropies(d, 'f', {'exponent': 'e', 'sign_mantissa': 'sm'})}", f"SELECT tensor, {six('sum(h * total) / 8')} AS ideal_bytes, {six('sum(h)')} AS ideal_bpw, {six(exponent)} AS exponent_bytes FROM en GROUP BY tensor"


@definition("documents", "benchmark")
def unigram_perplexity(d):
    """Held-out texts under word frequencies of the documents, with one count more for each word and one unknown."""
    t = f"t AS (SELECT {d.explode_words('text')} AS tok FROM documents), n AS (SELECT tok, count(*) AS n FROM t GROUP BY tok), a AS (SELECT sum(n) AS total, count(*) AS k FROM n), h AS (SELECT item_id, {d.explode_words('text')} AS tok FROM benchmark), q AS (SELECT item_id, tok, count(*) AS times FROM h GROUP BY item_id, tok)"
    b = "b AS (SELECT q.item_id, sum(q.times) AS n, sum(q.times * -ln((coalesce(n.n, 0) + 1.0) / (a.total + a.k + 1))) AS nll FROM q LEFT JOIN n ON q.tok = n.tok CROSS JOIN a GROUP BY q.item_id)"
    return f"{t}, {b}", f"SELECT item_id, {long('n')} AS n_tokens, {six('nll / n')} AS nll, ROUND(exp(nll / n), 2) AS perplexity FROM b"


@definition("words")
def phrases(d):
    """Runs of four exponents within a row that occur three times or more: the 16 commonest."""
    e = f"e AS (SELECT tensor, r, c, {d.shr('w', 7)} & 255 AS e FROM words), g AS (SELECT e AS a, lead(e, 1) OVER w AS b, lead(e, 2) OVER w AS f, lead(e, 3) OVER w AS h FROM e WINDOW w AS (PARTITION BY tensor, r ORDER BY c)), k AS (SELECT a, b, f, h, count(*) AS n FROM g WHERE h IS NOT NULL GROUP BY a, b, f, h)"
    return e, f"SELECT {long('a')} AS e0, {long('b')} AS e1, {long('f')} AS e2, {long('h')} AS e3, {long('n')} AS n FROM k WHERE n >= 3 ORDER BY n DESC, a, b, f, h LIMIT 16"


@definition("words")
def coherence(d):
    """How far the rows of a tensor point one way: the norm of their sum against the sum of their norms."""
    s = "s AS (SELECT tensor, c, sum(x) AS t, sum(x * x) AS q FROM words GROUP BY tensor, c)"
    return s, f"SELECT tensor, {six('sum(t * t)')} AS norm_of_sum, {six('sum(q)')} AS sum_of_norms, {six('sum(t * t) / sum(q)')} AS coherence FROM s GROUP BY tensor"


@definition("lineitem")
def column_tensor_stats(d):
    """A numeric column as a one-dimensional tensor."""
    return "", f"SELECT l_returnflag, {long('count(*)')} AS n, {six('avg(l_quantity)')} AS mean, {long('count(DISTINCT l_quantity)')} AS distinct_values FROM lineitem GROUP BY l_returnflag"


@definition("words")
def mixture_accounting(d):
    """For each tensor the cheaper of two exponent models, and what the choices cost together."""
    rows = [("'plain'", long("0")), ("'after_left'", long("coalesce(pe, 0)"))]
    a = f"f AS (SELECT tensor, {d.shr('w', 7)} & 255 AS e, {d.shr('left_w', 7)} & 255 AS pe FROM words), a AS ({d.stacked('f', ['tensor', 'e'], rows, ['model', 'ctx'])})"
    c = "c AS (SELECT tensor, model, ctx, e, count(*) AS n FROM a GROUP BY tensor, model, ctx, e), t AS (SELECT tensor, model, ctx, e, n, sum(n) OVER (PARTITION BY tensor, model, ctx) AS total FROM c), b AS (SELECT tensor, model, sum(-n * log2(n * 1.0 / total)) + 16 * count(*) AS bits FROM t GROUP BY tensor, model)"
    return f"{a}, {c}", f"SELECT tensor, {d.argmin('model', 'bits', 'model')} AS model, {six('min(bits) / 8')} AS bytes FROM b GROUP BY tensor"


@definition("words")
def coupling_tables(d):
    """For each exponent, the exponent that most often stands to its right (the smaller of equals)."""
    p = f"p AS (SELECT {d.shr('left_w', 7)} & 255 AS src, {d.shr('w', 7)} & 255 AS dst FROM words WHERE left_w IS NOT NULL), c AS (SELECT src, dst, count(*) AS n FROM p GROUP BY src, dst)"
    return p, f"SELECT {long('src')} AS src, {long(d.argmin('dst', '-n', 'dst'))} AS dst, {long('max(n)')} AS n, {long('sum(n)')} AS total FROM c GROUP BY src"
