"""The whole menu of tile encodings, priced from aggregates: predictors, references to earlier tiles, Huffman-coded
exponents with and without prediction, planes and palettes; profiles of it; and one table for a whole tensor against
tiles.

A stream of symbols is priced by its Huffman bits, which need its counts alone (at most 256 a tile).
"""

from __future__ import annotations

from wordloom.operators.costs import HEADER, MODES, in_tile, position_width, residual_cost
from wordloom.operators.fields import bits_needed, bpw
from wordloom.operators.stats import entropy
from wordloom.plans.dialect import definition, long, six

SPATIAL = ["raw", "constant", "value_dict", "prev_value", "prev_row", "const_pred", "duplicate_ref", "ref_prev_tile"]
CODED = [*SPATIAL, "components", "exp_huffman"]
NEW = [*CODED, "exp_spatial", "exp_hier"]
#: Menus by name.
PROFILES = {"uint16_spatial": SPATIAL, "coded": CODED, "new_modes": NEW, "hierarchical": [*NEW, "bit_planes", "transformed_ref", "position_dict"], "whole": ["raw", "exp_huffman"]}
#: Gain of entropy that lets a predicted stream compete; sides of blocks with a default each.
GATE, BLOCKS = 0.03, (8, 16, 32)


def _exponent(d, x):
    return f"({d.shr(x, 7)} & 255)"


def _streams(d):
    """CTE bodies: g (words in tiles with their neighbours and the word of the tile before), st (tensor, tile, stream,
    k, bits, h) of exponent streams, and sh (shapes of word symbols, as costs.shapes)."""
    before = "lag(w) OVER (PARTITION BY tensor, r % 4, c ORDER BY r)"
    tiles = in_tile(d).replace("SELECT tensor,", f"SELECT tensor, c, {before} AS t,", 1)
    e, swapped = _exponent(d, "w"), f"({d.shl('(t & 255)', 8)} | {d.shr('t', 8)})"
    modes = ", ".join(f"hd{b} AS (SELECT tensor, tile, blk, {d.argmin('sym', '-n', 'sym')} AS dflt FROM (SELECT tensor, tile, {d.div('c', b)} AS blk, {e} AS sym, count(*) AS n FROM g GROUP BY tensor, tile, {d.div('c', b)}, {e}) q GROUP BY tensor, tile, blk)" for b in BLOCKS)
    joins = " ".join(f"JOIN hd{b} ON g.tensor = hd{b}.tensor AND g.tile = hd{b}.tile AND {d.div('g.c', b)} = hd{b}.blk" for b in BLOCKS)
    kinds = {"exp": e, "exp_prev": d.xor(e, _exponent(d, "p")), "exp_row": d.xor(e, _exponent(d, "u"))} | {f"hier{b}": d.xor(e, f"d{b}") for b in BLOCKS}
    wide = f"gw AS (SELECT g.*, {', '.join(f'hd{b}.dflt AS d{b}' for b in BLOCKS)} FROM g {joins})"
    stacked = d.stacked("gw", ["tensor", "tile"], [(f"'{n}'", long(x)) for n, x in kinds.items()], ["stream", "sym"])
    defaults = " UNION ALL ".join(f"SELECT tensor, tile, 'defaults{b}' AS stream, {long('dflt')} AS sym FROM hd{b}" for b in BLOCKS)
    counts = f"sx AS ({stacked} UNION ALL {defaults}), sc AS (SELECT tensor, tile, stream, sym, count(*) AS n FROM sx GROUP BY tensor, tile, stream, sym), se AS (SELECT tensor, tile, stream, n, sum(n) OVER (PARTITION BY tensor, tile, stream) AS total FROM sc)"
    shape = f"sa AS (SELECT tensor, tile, stream, count(*) AS k, sum({entropy('n', 'total')}) AS h FROM se GROUP BY tensor, tile, stream)"
    words = {"word": "w", "exponent": e, "prev_value": d.xor("w", "p"), "prev_row": d.xor("w", "u"), "prev_tile": f"CASE WHEN t IS NOT NULL THEN {d.xor('w', 't')} END", "prev_swapped": f"CASE WHEN t IS NOT NULL THEN {d.xor('w', swapped)} END"}
    symbols = d.stacked("g", ["tensor", "tile"], [(f"'{n}'", long(x)) for n, x in words.items()], ["kind", "sym"])
    shapes = f"wy AS ({symbols}), wc AS (SELECT tensor, tile, kind, sym, count(*) AS n FROM wy WHERE sym IS NOT NULL GROUP BY tensor, tile, kind, sym), sh AS (SELECT tensor, tile, kind, sum(n) AS n, count(*) AS k, sum(n) - max(n) AS x FROM wc GROUP BY tensor, tile, kind)"
    return f"{tiles}, {modes}, {wide}, {counts}, {shape}, {d.huffman('sc', ['tensor', 'tile', 'stream'], 'n', 'hb')}, st AS (SELECT a.tensor, a.tile, a.stream, a.k, a.h, b.bits FROM sa a JOIN hb b ON a.tensor = b.tensor AND a.tile = b.tile AND a.stream = b.stream), {shapes}"


def prices(d):
    """CTE bodies that end in mp (tensor, tile, n, mode_id, mode_name, bytes): all that the menu offers."""
    ceil8 = lambda x: d.div(f"{x} + 7", 8)
    many = "999999999"
    pick = lambda column, stream: f"max(CASE WHEN stream = '{stream}' THEN {column} END)"
    names = ["exp", "exp_prev", "exp_row", *[f"hier{b}" for b in BLOCKS], *[f"defaults{b}" for b in BLOCKS]]
    wide = ", ".join(f"{pick(c, s)} AS {c}_{s}" for s in names for c in ("k", "bits", "h"))
    res = residual_cost(d)
    shape = ", ".join(f"max(CASE WHEN kind = '{kind}' THEN {x} END) AS {c}_{kind}" for kind, c, x in [("word", "n", "n"), ("word", "k", "k"), ("word", "x", "x"), ("exponent", "k", "k"), *[(kind, "n", "n") for kind in ("prev_tile", "prev_swapped")], *[(kind, "cost", res) for kind in ("word", "prev_value", "prev_row", "prev_tile", "prev_swapped")]])
    planes = ", ".join(f"sum({d.shr('w', i)} & 1) AS b{i}" for i in range(16))
    plane = lambda i: f"CASE WHEN b{i} = 0 OR b{i} = cnt THEN 1 ELSE least(6 + {position_width('cnt')} * least(b{i}, cnt - b{i}), 1 + {ceil8('cnt')}) END"
    same = " + ".join(f"CASE WHEN b{i} = 0 OR b{i} = cnt THEN 1 ELSE 0 END" for i in range(16))
    content = f"dk AS (SELECT tensor, tile, {d.joined(d.hexword('w'), 'o')} AS content FROM (SELECT tensor, {d.div('r', 4)} AS tile, r * 65536 + c AS o, w FROM words) q GROUP BY tensor, tile), dr AS (SELECT tensor, tile, min(tile) OVER (PARTITION BY tensor, content) AS first_tile FROM dk)"
    coded = lambda stream, extra: f"({extra} + 2 + 2 * k_{stream} + {ceil8(f'bits_{stream}')} + n)"
    better = lambda stream, than="exp": f"h_{stream} <= h_{than} - {GATE}"
    hier = ", ".join(f"CASE WHEN {better(f'hier{b}')} THEN 13 + 2 + 2 * k_defaults{b} + {ceil8(f'bits_defaults{b}')} + {coded(f'hier{b}', 6)} ELSE {many} END" for b in BLOCKS)
    k1 = "(k_word - 1)"
    palette = f"5 + 2 * {k1} + least(4 + x_word * {position_width('n')}, {ceil8('n')}) + {ceil8(f'x_word * ({bits_needed(d, k1)})')}"
    value = f"2 + 2 * k_word + {ceil8('n * (' + bits_needed(d, 'k_word') + ')')}"
    exponent_bits = bits_needed(d, "k_exponent")
    parts = f"5 + n + CASE WHEN k_exponent > 1 AND k_exponent <= 16 THEN 2 + k_exponent + {ceil8(f'n * ({exponent_bits})')} ELSE n END"
    rows = {
        "raw": ("2 * n", "TRUE"),
        "constant": ("2", "k_word = 1"),
        "value_dict": (value, f"k_word BETWEEN 2 AND 16 AND {value} < 2 * n"),
        "prev_value": ("cost_prev_value", "TRUE"),
        "prev_row": ("cost_prev_row", "TRUE"),
        "const_pred": ("2 + cost_word", "TRUE"),
        "duplicate_ref": ("4", "first_tile < tile"),
        "components": (parts, f"{parts} < 2 * n"),
        "ref_prev_tile": ("cost_prev_tile", "n_prev_tile = n AND cost_prev_tile < 2 * n"),
        "exp_huffman": (f"least({coded('exp', 7)}, {coded('exp_prev', 7)})", f"least({coded('exp', 7)}, {coded('exp_prev', 7)}) < 2 * n"),
        "exp_spatial": (f"least({coded('exp', 7)}, CASE WHEN {better('exp_prev')} THEN {coded('exp_prev', 7)} ELSE {many} END, CASE WHEN {better('exp_row')} THEN {coded('exp_row', 7)} ELSE {many} END)", "TRUE"),
        "exp_hier": (f"least({hier})", f"least({hier}) < 2 * n"),
        "bit_planes": (" + ".join(plane(i) for i in range(16)), f"{same} >= 1"),
        "transformed_ref": ("5 + least(cost_prev_tile, cost_prev_swapped)", "n_prev_tile = n AND 5 + least(cost_prev_tile, cost_prev_swapped) < 2 * n"),
        "position_dict": (palette, f"x_word > 0 AND k_word <= 17 AND {palette} < 2 * n"),
    }
    for name in ("exp_spatial", "bit_planes"):
        rows[name] = rows[name][0], f"{rows[name][1]} AND {rows[name][0]} < 2 * n"
    priced = d.stacked("mt", ["tensor", "tile", "n"], [(long(MODES[m]), f"'{m}'", long(f"CASE WHEN {when} THEN {HEADER} + {cost} END")) for m, (cost, when) in rows.items()], ["mode_id", "mode_name", "bytes"])
    return f"{_streams(d)}, mw AS (SELECT tensor, tile, {wide} FROM st GROUP BY tensor, tile), ms AS (SELECT tensor, tile, {shape} FROM sh GROUP BY tensor, tile), mb AS (SELECT tensor, tile, count(*) AS cnt, {planes} FROM g GROUP BY tensor, tile), {content}, mt AS (SELECT mw.*, ms.n_word AS n, ms.k_word, ms.x_word, ms.k_exponent, ms.n_prev_tile, ms.cost_word, ms.cost_prev_value, ms.cost_prev_row, ms.cost_prev_tile, ms.cost_prev_swapped, mb.cnt, {', '.join(f'mb.b{i}' for i in range(16))}, dr.first_tile FROM mw JOIN ms ON mw.tensor = ms.tensor AND mw.tile = ms.tile JOIN mb ON mw.tensor = mb.tensor AND mw.tile = mb.tile JOIN dr ON mw.tensor = dr.tensor AND mw.tile = dr.tile), mp AS (SELECT * FROM ({priced}) q WHERE bytes IS NOT NULL)"


def whole(d):
    """CTE bodies: wh (tensor, n, bytes) of one Huffman table of a tensor's exponents, plain or by the word before."""
    e = _exponent(d, "w")
    parts = d.stacked("words", ["tensor"], [("'exp'", long(e)), ("'exp_prev'", long(d.xor(e, _exponent(d, "coalesce(prev_w, 0)"))))], ["stream", "sym"])
    cost = f"{HEADER} + 7 + 2 + 2 * k + {d.div('bits + 7', 8)} + n"
    return f"hx AS ({parts}), hc AS (SELECT tensor, stream, sym, count(*) AS n FROM hx GROUP BY tensor, stream, sym), hn AS (SELECT tensor, stream, sum(n) AS n, count(*) AS k FROM hc GROUP BY tensor, stream), {d.huffman('hc', ['tensor', 'stream'], 'n', 'hw')}, wh AS (SELECT hn.tensor, max(hn.n) AS n, min({cost}) AS bytes FROM hn JOIN hw ON hn.tensor = hw.tensor AND hn.stream = hw.stream GROUP BY hn.tensor)"


@definition("words")
def menu_prices(d):
    return prices(d), f"SELECT tensor, {long('tile')} AS tile, {long('mode_id')} AS mode_id, mode_name, bytes FROM mp"


@definition("words")
def menu_choice(d):
    """The cheapest encoding of each tile, ties by its number."""
    return prices(d), f"SELECT tensor, {long('tile')} AS tile, {long('min(bytes)')} AS bytes, {long(d.argmin('mode_id', 'bytes', 'mode_id'))} AS mode_id, {d.argmin('mode_name', 'bytes', 'mode_id')} AS mode_name FROM mp GROUP BY tensor, tile"


@definition("words")
def whole_or_tiles(d):
    """One table for a tensor against the cheapest encoding of each of its tiles, in complete bytes."""
    t = "tb AS (SELECT tensor, tile, min(bytes) AS bytes FROM mp GROUP BY tensor, tile), tt AS (SELECT tensor, sum(bytes) AS bytes FROM tb GROUP BY tensor)"
    return f"{prices(d)}, {whole(d)}, {t}", f"SELECT wh.tensor, {long('tt.bytes')} AS tiled_bytes, {long('wh.bytes')} AS whole_bytes, CASE WHEN wh.bytes < tt.bytes THEN 'whole' ELSE 'tiles' END AS chosen, {six(bpw('least(wh.bytes, tt.bytes)', 'wh.n'))} AS bpw FROM wh JOIN tt ON wh.tensor = tt.tensor"


@definition("words")
def profile_sizes(d):
    """Bytes of all tensors under each named menu, and of the whole-tensor table where the menu has one."""
    member = ", ".join(f"('{p}', '{m}')" for p, modes in PROFILES.items() for m in modes)
    t = f"pf AS {d.values(member, 'profile', 'mode')}, pt AS (SELECT pf.profile, mp.tensor, mp.tile, min(mp.bytes) AS bytes FROM mp JOIN pf ON mp.mode_name = pf.mode GROUP BY pf.profile, mp.tensor, mp.tile), ps AS (SELECT profile, tensor, sum(bytes) AS bytes, count(*) AS tiles FROM pt GROUP BY profile, tensor)"
    best = "CASE WHEN ps.profile = 'uint16_spatial' THEN ps.bytes ELSE least(ps.bytes, wh.bytes) END"
    return f"{prices(d)}, {whole(d)}, {t}", f"SELECT ps.profile, {long('sum(ps.tiles)')} AS tiles, {long('sum(ps.bytes)')} AS tiled_bytes, {long(f'sum({best})')} AS bytes, {six(bpw(f'sum({best})', 'sum(wh.n)'))} AS bpw FROM ps JOIN wh ON ps.tensor = wh.tensor GROUP BY ps.profile"
