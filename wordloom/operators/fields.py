"""Words, their fields, scalar functions and labels; tiles and traversals; scans by range."""

from __future__ import annotations

from wordloom.plans.dialect import definition, long, six

# Bit patterns that must survive every step.
SPECIAL_WORDS = [0x0000, 0x8000, 0x7F80, 0xFF80, 0x7FC1, 0x7F81, 0x0001, 0x8001]
# Names of tensors in the usual layout, for the label functions.
NAMES = ["model.embed_tokens.weight", "model.layers.0.self_attn.q_proj.weight", "model.layers.0.self_attn.k_proj.bias", "model.layers.11.self_attn.o_proj.weight", "model.layers.11.mlp.gate_proj.weight", "model.layers.23.mlp.down_proj.weight", "model.layers.23.input_layernorm.weight", "model.norm.weight", "lm_head.weight"]


def fields(d, w="w"):
    return f"{d.shr(w, 15)} AS s, {d.shr(w, 7)} & 255 AS e, {w} & 127 AS m"


def names(d):
    return d.values(", ".join(f"('{n}')" for n in NAMES), "name")


@definition("words")
def tensor_inventory(d):
    return "", f"SELECT tensor, {long('count(DISTINCT r)')} AS n_rows, {long('max(c) + 1')} AS n_cols, {long('count(*)')} AS n_words, {long('2 * count(*)')} AS n_bytes FROM words GROUP BY tensor"


@definition("words")
def word_slice(d):
    return "", "SELECT tensor, r * 64 + c AS seq, w FROM words WHERE r * 64 + c BETWEEN 100 AND 400"


@definition("words")
def word_region(d):
    return "", "SELECT tensor, r, c, w FROM words WHERE r >= 2 AND r < 7 AND c >= 16 AND c < 40"


@definition("words")
def rne_words(d):
    return "", "SELECT tensor, r, c, w FROM words"


@definition("words")
def bf16_fields(d):
    back = f"({d.shl('s', 15)} | {d.shl('e', 7)} | m)"
    packed = f"({d.shl('s', 7)} | m)"
    return f"f AS (SELECT tensor, w, {fields(d)} FROM words)", f"SELECT tensor, s, e, {long('count(*)')} AS n, {long('sum(m)')} AS m_sum, {long(f'sum({packed})')} AS packed_sum, {long(f'sum(CASE WHEN {back} <> w THEN 1 ELSE 0 END)')} AS differing FROM f GROUP BY tensor, s, e"


@definition()
def all_words(d):
    x = f"a AS (SELECT i AS w, {fields(d, 'i')} FROM {d.numbers(65536)} z)"
    wide = d.shl("w", 16)
    again = f"({d.shr(f'({wide} + 32767 + ({d.shr(wide, 16)} & 1))', 16)} & 65535)"
    return x, f"SELECT {long('w')} AS w, {long('s')} AS s, {long('e')} AS e, {long('m')} AS m, {long(wide)} AS float_bits, {long(again)} AS rounded FROM a"


@definition()
def special_words(d):
    rows = ", ".join(f"({w})" for w in SPECIAL_WORDS)
    return f"a AS (SELECT w, {fields(d)} FROM {d.values(rows, 'w')} z)", f"SELECT {long('w')} AS w, CASE WHEN e = 255 AND m = 0 THEN 'inf' WHEN e = 255 THEN 'nan' WHEN e = 0 AND m = 0 THEN 'zero' WHEN e = 0 THEN 'subnormal' ELSE 'normal' END AS kind, {long('s')} AS sign FROM a"


@definition()
def logical_shapes(d):
    rows = "(1, 0, 0, 0, 0), (2, 1, 64, 0, 0), (3, 2, 32, 64, 0), (4, 3, 4, 8, 16), (5, 3, 1, 1, 7)"
    return "", f"SELECT {long('id')} AS id, {long('CASE WHEN k = 0 THEN 0 WHEN k = 1 THEN 1 ELSE a END')} AS n_rows, {long('CASE WHEN k = 0 THEN 0 WHEN k = 1 THEN a WHEN k = 2 THEN b ELSE b * c END')} AS n_cols FROM {d.values(rows, 'id', 'k', 'a', 'b', 'c')} t"


def family(d):
    return f"""CASE WHEN {d.matches('name', 'embed_tokens|wte')} THEN 'embedding' WHEN {d.matches('name', 'lm_head')} THEN 'head' WHEN {d.matches('name', 'norm')} THEN 'norm'
WHEN {d.matches('name', 'bias$')} THEN 'bias' WHEN {d.matches('name', 'self_attn|attention')} THEN 'attention' WHEN {d.matches('name', 'mlp|feed_forward')} THEN 'mlp' ELSE 'other' END"""


@definition()
def name_labels(d):
    layer = d.extract("name", "layers[.]([0-9]+)", 1)
    role = "regexp_replace(name, '(layers?)[.][0-9]+', 'layers')"
    linear = f"{d.matches('name', 'weight$')} AND NOT {d.matches('name', 'norm|embed_tokens')}"
    return f"n AS (SELECT name FROM {names(d)} z)", f"SELECT name, CASE WHEN {layer} = '' THEN -1 ELSE CAST({layer} AS BIGINT) END AS layer, {role} AS role, ({linear}) AS linear, {family(d)} AS family FROM n"


POLICY = "('embedding', 8, 7), ('head', 8, 7), ('norm', 16, 7), ('bias', 16, 7), ('attention', 6, 5), ('mlp', 5, 4), ('other', 16, 7)"


@definition()
def policy_bits(d):
    return f"n AS (SELECT name, {family(d)} AS family FROM {names(d)} z), p AS {d.values(POLICY, 'family', 'bits', 'keep')}", f"SELECT n.name, n.family, {long('p.bits')} AS bits, {long('p.keep')} AS keep, {long('7 - p.keep')} AS dropped FROM n JOIN p ON n.family = p.family"


@definition("documents")
def token_classes(d):
    t = f"t AS (SELECT {d.explode_words('text')} AS tok FROM documents)"
    kind = f"CASE WHEN {d.matches('tok', '^(the|of|and|to|in|a|is|that|it|for)$')} THEN 'function' WHEN length(tok) <= 2 THEN 'short' WHEN {d.matches('tok', '(ing|ed|ly|tion)$')} THEN 'suffixed' ELSE 'plain' END"
    return t, f"SELECT {kind} AS class, {long('count(*)')} AS n, {long('count(DISTINCT tok)')} AS distinct_tokens FROM t GROUP BY {kind}"


def bpw(bytes_, words_):
    return f"CASE WHEN {words_} <= 0 THEN 0.0 ELSE 8.0 * {bytes_} / {words_} END"


def band(x):
    return f"CASE WHEN {x} <= 1 THEN 'extreme' WHEN {x} <= 2 THEN 'one_gb_class' WHEN {x} <= 4 THEN 'exceptional' WHEN {x} <= 8 THEN 'strong' ELSE 'not_exceptional' END"


@definition()
def qualification_bands(d):
    rows = "(1, 801, 800), (2, 800, 800), (3, 400, 800), (4, 200, 800), (5, 100, 800), (6, 50, 0)"
    return f"b AS (SELECT id, {bpw('bytes', 'words')} AS bpw FROM {d.values(rows, 'id', 'bytes', 'words')} z)", f"SELECT {long('id')} AS id, {six('bpw')} AS bpw, {band('bpw')} AS band, bpw <= 4 AS high_potential FROM b"


@definition()
def popcounts(d):
    return "", f"SELECT {long(d.pop('i'))} AS ones, {long('count(*)')} AS n FROM {d.numbers(65536)} z GROUP BY {d.pop('i')}"


def bits_needed(d, k):
    return f"CASE WHEN {k} <= 1 THEN 0 ELSE {d.binlen(f'CAST({k} - 1 AS BIGINT)')} END"


@definition()
def bit_widths(d):
    packed = d.div(f"100 * ({bits_needed(d, 'i')}) + 7", 8)
    return "", f"SELECT {long('i')} AS k, {long(bits_needed(d, 'i'))} AS bits, {long('CASE WHEN i <= 256 THEN 1 WHEN i <= 65536 THEN 2 ELSE 4 END')} AS position_bytes, {long(packed)} AS packed_100 FROM {d.numbers(300)} z"


@definition("words")
def transforms(d):
    flipped = d.xor("w", 32768)
    swapped = f"({d.shl('(w & 255)', 8)} | {d.shr('w', 8)})"
    return "", f"SELECT tensor, {long('sum(w)')} AS same, {long(f'sum({flipped})')} AS sign_flipped, {long(f'sum({swapped})')} AS byte_swapped, {long('sum(w * (c * 64 + r % 64))')} AS transposed_check FROM words GROUP BY tensor"


@definition()
def gray_roundtrip(d):
    g = f"({d.xor('i', d.shr('i', 1))} & 127)"
    one = d.xor("g", d.shr("g", 1))
    two = d.xor("a", d.shr("a", 2))
    three = d.xor("b", d.shr("b", 4))
    return f"x AS (SELECT i, {g} AS g FROM {d.numbers(128)} z), y AS (SELECT i, g, {one} AS a FROM x), v AS (SELECT i, g, {two} AS b FROM y)", f"SELECT {long('i')} AS m, {long('g')} AS gray, {long(three)} AS back FROM v"


@definition("words")
def haar_bands(d):
    pairs = "p AS (SELECT tensor, r, c, w & 127 AS a, lead(w & 127) OVER (PARTITION BY tensor, r ORDER BY c) AS b FROM words)"
    half = d.shr("dd", 1)
    low = f"(b + {d.shr('(a - b)', 1)})"
    return f"{pairs}, h AS (SELECT tensor, a, b, a - b AS dd, {low} AS ss FROM p WHERE c % 2 = 0 AND b IS NOT NULL)", f"SELECT tensor, {long('sum(abs(dd))')} AS detail, {long('sum(ss)')} AS smooth, {long(f'sum(CASE WHEN ss - {half} <> b OR dd + ss - {half} <> a THEN 1 ELSE 0 END)')} AS differing FROM h GROUP BY tensor"


def keep_k(d, k):
    """Mantissas rounded to k bits, half up, with the carry into the exponent."""
    r = 7 - k
    q = f"{d.shr(f'(m + {1 << (r - 1)})', r)}"
    carry = f"({q} = {1 << k})"
    e2 = f"(CASE WHEN {carry} THEN e + 1 ELSE e END)"
    m2 = f"(CASE WHEN {carry} OR {e2} = 255 THEN 0 ELSE ({d.shl(q, r)} & 127) END)"
    return f"(CASE WHEN e = 255 THEN w ELSE ({d.shl('s', 15)} | {d.shl(e2, 7)} | {m2}) END)"


@definition("words")
def keep_k_ladder(d):
    parts = d.stacked("f", ["tensor", "w"], [(long(k), long(keep_k(d, k))) for k in range(1, 7)], ["keep", "kept"])
    return f"f AS (SELECT tensor, w, {fields(d)} FROM words), k AS ({parts})", f"SELECT tensor, {long('keep')} AS keep, {long('sum(CASE WHEN w <> kept THEN 1 ELSE 0 END)')} AS changed, {long('sum(abs(w - kept))')} AS moved, {long('count(DISTINCT kept)')} AS distinct_words, {long('sum(kept)')} AS total FROM k GROUP BY tensor, keep"


@definition("words")
def split_exceptions(d):
    """Words of four kept bits, rows with r % 5 = 0 left as they are: those with low bits are exceptions."""
    q = f"f AS (SELECT tensor, r, w, {fields(d)} FROM words), q AS (SELECT tensor, CASE WHEN r % 5 = 0 THEN w ELSE {keep_k(d, 4)} END AS w FROM f), x AS (SELECT tensor, w, ({d.shl(d.shr('w', 3), 3)}) AS rebuilt FROM q)"
    return q, f"SELECT tensor, {long('sum(CASE WHEN rebuilt <> w THEN 1 ELSE 0 END)')} AS exceptions, {long('sum(CASE WHEN rebuilt <> w THEN w ELSE 0 END)')} AS exception_sum, {long('count(*)')} AS n FROM x GROUP BY tensor"


@definition()
def quantiser_codes(d):
    return "", f"SELECT {long('i')} AS bits, {long(d.shl(1, 'i - 1') + ' - 1')} AS qmax, {long(d.shl(1, 'i') + ' - 2')} AS top_code, {six('1.0 / POWER(POWER(2, i) - 1, 2)')} AS mse_proxy, {long('4096 * i + 64 * 24 + 3 * 48')} AS packed_bits FROM {d.numbers(9)} z WHERE i >= 2"


@definition()
def exception_map_cost(d):
    cost = f"i * ({bits_needed(d, '1000')})"
    return "", f"SELECT {long('i')} AS recovered, {long(f'CASE WHEN 1000 <= {cost} THEN 1000 ELSE {cost} END')} AS map_bits, CASE WHEN 1000 <= {cost} THEN 'bitmap' ELSE 'index' END AS scheme FROM {d.numbers(200)} z"


@definition("words")
def word_sha256(d):
    b = d.joined(f"concat({d.hexbyte('w & 255')}, {d.hexbyte(d.shr('w', 8))})", "r * 64 + c")
    return "", f"SELECT tensor, {d.sha(b)} AS sha256, {long('2 * count(*)')} AS n_bytes FROM words GROUP BY tensor"


@definition()
def tile_shapes(d):
    rows = ", ".join(f"({b}, {r}, {c})" for b in (64, 128, 256) for r, c in ((1, 17), (17, 13), (64, 64), (50, 300), (3, 5), (1, 1024)))
    flat = f"{d.div('block', 'cols')}"
    th = f"greatest(1, least(n_rows, {flat}))"
    ok = f"(cols >= 2 AND cols <= block AND ({th} >= 2 OR n_rows = 1))"
    root = "CAST(floor(sqrt(block)) AS BIGINT)"
    tw = f"least(cols, {root})"
    return f"s AS (SELECT CAST(block AS BIGINT) AS block, CAST(n_rows AS BIGINT) AS n_rows, CAST(cols AS BIGINT) AS cols FROM {d.values(rows, 'block', 'n_rows', 'cols')} z)", f"SELECT block, n_rows, cols, {long(f'CASE WHEN {ok} THEN {th} ELSE greatest(1, least(n_rows, ' + d.div('block', tw) + ')) END')} AS tile_rows, {long(f'CASE WHEN {ok} THEN cols ELSE {tw} END')} AS tile_cols FROM s"


@definition("words")
def tile_origins(d):
    t = f"t AS (SELECT tensor, {d.div('r', 8)} AS tr, {d.div('c', 8)} AS tc, w FROM words)"
    return t, f"SELECT tensor, {long('tr * 8 + tc')} AS tile_index, {long('min(tr) * 8')} AS row0, {long('min(tc) * 8')} AS col0, {long('count(*)')} AS n, {long('sum(w)')} AS word_sum FROM t GROUP BY tensor, tr, tc"


TRAVERSALS = ("row", "row_serp", "col", "col_serp")


def traversal(name):
    """Order keys within 8 x 8 tiles."""
    return {"row": "y * 8 + x", "row_serp": "y * 8 + CASE WHEN y % 2 = 0 THEN x ELSE 7 - x END", "col": "x * 8 + y", "col_serp": "x * 8 + CASE WHEN x % 2 = 0 THEN y ELSE 7 - y END"}[name]


@definition("words")
def traversals(d):
    parts = d.stacked("g", ["tensor", "t", "w"], [(f"'{n}'", long(traversal(n))) for n in TRAVERSALS], ["traversal", "o"])
    g = f"g AS (SELECT tensor, {d.div('r', 8)} * 8 + {d.div('c', 8)} AS t, r % 8 AS y, c % 8 AS x, w & 127 AS w FROM words), a AS ({parts})"
    s = "s AS (SELECT tensor, traversal, w, lag(w) OVER (PARTITION BY tensor, t, traversal ORDER BY o) AS p FROM a)"
    return f"{g}, {s}", f"SELECT tensor, traversal, {long('sum(CASE WHEN w = p THEN 1 ELSE 0 END)')} AS repeats, {long('sum(abs(w - p))')} AS movement FROM s GROUP BY tensor, traversal"


@definition("words")
def bit_plane_ones(d):
    """Sixteen conditional sums in one pass, then a row for each plane."""
    ones = ", ".join(f"sum({d.shr('w', i)} & 1) AS b{i}" for i in range(16))
    planes = d.stacked("p", ["tensor", "n"], [(long(i), long(f"b{i}")) for i in range(16)], ["plane", "ones"])
    return f"p AS (SELECT tensor, count(*) AS n, {ones} FROM words GROUP BY tensor)", f"SELECT tensor, plane, ones, {six('ones * 1.0 / n')} AS share FROM ({planes}) q"


@definition("words")
def full_tiles(d):
    n = f"n AS (SELECT tensor, max(r) + 1 AS h FROM words GROUP BY tensor)"
    return n, f"SELECT w.tensor, {long(d.div('w.r', 16))} AS tr, {long(d.div('w.c', 16))} AS tc, {long('count(*)')} AS n, {long('sum(w.w & 127)')} AS m_sum FROM words w JOIN n ON w.tensor = n.tensor WHERE w.r < {d.div('n.h', 16)} * 16 GROUP BY w.tensor, {d.div('w.r', 16)}, {d.div('w.c', 16)}"


@definition("words")
def sample_origins(d):
    n = "n AS (SELECT tensor, max(r) + 1 AS n FROM words GROUP BY tensor)"
    return f"{n}, k AS (SELECT i FROM {d.numbers(8)} z), o AS (SELECT DISTINCT tensor, {d.rint('i * (n - 1) / 7.0')} AS r FROM n CROSS JOIN k)", f"SELECT o.tensor, {long('o.r')} AS r, {long('sum(w.w)')} AS word_sum FROM o JOIN words w ON w.tensor = o.tensor AND w.r = CAST(o.r AS BIGINT) GROUP BY o.tensor, o.r"


@definition("words")
def chunk_subsample(d):
    """Three chunks of 256 words: start, middle, end."""
    n = "n AS (SELECT tensor, count(*) AS n FROM words GROUP BY tensor), q AS (SELECT w.tensor, w.r * 64 + w.c AS seq, w.w, n.n FROM words w JOIN n ON w.tensor = n.tensor)"
    middle = f"({d.div('n', 2)} - 128)"
    return n, f"SELECT tensor, CASE WHEN seq < 256 THEN 'start' WHEN seq >= n - 256 THEN 'end' ELSE 'middle' END AS chunk, {long('count(*)')} AS n_words, {long('sum(w)')} AS word_sum FROM q WHERE seq < 256 OR (seq >= {middle} AND seq < {middle} + 256) OR seq >= n - 256 GROUP BY tensor, CASE WHEN seq < 256 THEN 'start' WHEN seq >= n - 256 THEN 'end' ELSE 'middle' END"


@definition("words")
def reservoir(d):
    q = f"q AS (SELECT tensor, r, c, w, row_number() OVER (PARTITION BY tensor ORDER BY {d.hash_order('r * 64 + c', 7)}, r, c) AS k FROM words)"
    return q, "SELECT tensor, r, c, w FROM q WHERE k <= 32"


@definition("benchmark")
def held_out_texts(d):
    return "", f"SELECT item_id, {long('length(text)')} AS n_chars FROM benchmark"
