"""Quality rules by distribution divergence, in DataFrame expressions alone.

Each language has a reference, summed over the whole texts of all documents that name it: how its characters fall into
classes, and how often each of its most common words stands in its text. A document is compared by Jensen-Shannon
distance (the root of the divergence in bits, 0 to 1) with the reference of its language; where that is far or not
known, with the others, since a wrong label is no fault of the text. It is rejected if it is farther than a limit from
all of them. Histograms of short texts scatter: below a least number of characters or words a histogram is no evidence,
and above it the limit is wider by what sampling alone makes of it (a term in 1/n).

Base rules reject before that: fewer than 50 words, or over half of all words in three-word windows that repeat.

Cases: null text counts as empty and fails the base rules; a null or empty language is compared with all; a language
with too few words for a reference is no evidence, so only the base rules hold for its documents; without any reference (an empty table, no words) only the base rules hold; rows that repeat an id
each get a row. Windows are compared by 64-bit hash within a text. Other columns pass through in `wl_row`.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.llm.common import stored, whole_text
from wordloom.llm.spans import let

SPACE = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Common words of a reference.
COMMON = 64
#: Least code points and words that make a histogram evidence, and the limits of distance.
LEAST_CHARS, LEAST_WORDS = 200, 80
CHAR_LIMIT, WORD_LIMIT = 0.30, 0.47
#: Words that a language needs for a reference.
REFERENCE_WORDS = 5000
CLASSES = ["upper", "digit", "symbol", "space", "other"]


def _marks(text: Column) -> Column:
    """The capitals, digits and symbols of a text, in one pass; they are few."""
    return F.regexp_replace(text, r"[^\p{Lu}0-9#*$%&|<>]++", "")


def _counts(marks: Column, chars: Column, in_words: Column) -> dict[str, Column]:
    """Code points of each class."""
    digit = F.length(F.regexp_replace(marks, "[^0-9]++", ""))
    symbol = F.length(F.regexp_replace(marks, r"[^#*$%&|<>]++", ""))
    return {"upper": F.length(marks) - digit - symbol, "digit": digit, "symbol": symbol, "space": chars - in_words, "other": in_words - F.length(marks)}


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPLIT), lambda w: w != "")


def _language(docs: DataFrame, lang: str) -> Column:
    return F.coalesce(F.col(lang).cast("string"), F.lit("")) if lang in docs.columns else F.lit("")


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> list[dict]:
    """A reference for each language with enough words: lang, classes (shares), words (lower-case word to share of all words)."""
    rows = docs.select(_language(docs, lang).alias("lang"), whole_text(text).alias("text")).filter("lang <> ''")
    words = rows.select("lang", F.explode(F.split(F.lower("text"), SPLIT)).alias("word")).filter("word <> ''")
    counts = stored(words.groupBy("lang", "word").agg(F.count("*").alias("n")), "word-counts")
    # two passes over the texts: the words, of which totals are sums, and the marks
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.length("word")).alias("in_words"))
    totals = totals.filter(F.col("n") >= REFERENCE_WORDS).collect()
    if not totals:
        return []
    out = {r.lang: {"lang": r.lang, "n": r.n, "in_words": r.in_words, "classes": {}, "words": {}} for r in totals}
    for r in counts.withColumn("r", F.row_number().over(top)).filter(F.col("r") <= COMMON).filter(F.col("lang").isin(*out)).collect():
        out[r.lang]["words"][r.word] = r.n / out[r.lang]["n"]
    marks = rows.select("lang", F.length("text").alias("chars"), _marks(F.col("text")).alias("marks"))
    marks = marks.select("lang", "chars", F.length("marks").alias("marks"), *[c.alias(k) for k, c in _counts(F.col("marks"), F.lit(0), F.lit(0)).items() if k in ("upper", "digit", "symbol")])
    for r in marks.groupBy("lang").agg(*[F.sum(c).alias(c) for c in ("chars", "marks", "upper", "digit", "symbol")]).filter(F.col("lang").isin(*out)).collect():
        own = out[r.lang]
        n = {"upper": r.upper, "digit": r.digit, "symbol": r.symbol, "space": r.chars - own["in_words"], "other": own["in_words"] - r.marks}
        own["classes"] = {c: max(0, n[c]) / r.chars for c in CLASSES}
    return sorted(out.values(), key=lambda x: x["lang"])


def _half(p: Column, q: Column) -> Column:
    """p log2(p / m), m the mean of p and q."""
    return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(F.lit(0.0))


def _root(divergence: Column) -> Column:
    return F.sqrt(F.greatest(divergence, F.lit(0.0)))


def _literal(refs: list[dict]) -> Column:
    """All references as one constant, so that the plan does not grow with them."""
    rows = [{"lang": r["lang"], "classes": [r["classes"][c] for c in CLASSES], "words": dict(sorted(r["words"].items())), "rest": 1 - sum(r["words"].values())} for r in refs]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<lang:string,classes:array<double>,words:map<string,double>,rest:double>>")


def char_distance(shares: dict[str, Column], reference: Column) -> Column:
    terms = [_half(shares[c], F.get(reference.classes, F.lit(i))) + _half(F.get(reference.classes, F.lit(i)), shares[c]) for i, c in enumerate(CLASSES)]
    return _root(sum(terms[1:], terms[0]) / 2)


def word_distance(words: Column, reference: Column) -> Column:
    """Bins are the common words of the reference, and all others together. Bins that the document lacks add half
    their share."""
    rest = reference.rest
    common = F.sort_array(F.filter(words, lambda w: F.map_contains_key(reference.words, w)))

    def measured(own: Column) -> Column:
        n = F.size(words).cast("double")
        ends = F.filter(F.sequence(F.lit(1), F.greatest(F.size(own), F.lit(1))), lambda i: (i <= F.size(own)) & ~F.get(own, i - 1).eqNullSafe(F.get(own, i)))

        def bins(at: Column) -> Column:
            hits = F.transform(at, lambda e, i: F.struct(((e - F.coalesce(F.get(at, i - 1), F.lit(0))) / n).alias("p"), F.try_element_at(reference.words, F.get(own, e - 1)).alias("q")))
            seen = F.aggregate(hits, F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("q")), lambda a, h: F.struct((a.d + _half(h.p, h.q) + _half(h.q, h.p)).alias("d"), (a.q + h.q).alias("q")))
            p0, q0 = 1 - F.size(own) / n, F.greatest(rest, F.lit(0.0))
            return let(seen, lambda s: _root((s.d + _half(p0, q0) + _half(q0, p0) + (1 - rest - s.q)) / 2))

        return let(ends, bins)

    return let(common, measured)


def _repeated(words: Column) -> Column:
    """Words in three-word windows that stand twice or more in the text."""

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(at: Column) -> Column:
        """Words of the windows at these places, which ascend."""
        return F.aggregate(F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    def places(h: Column, twice: Column) -> Column:
        """Places of the windows that repeat: looked up in a short list of those, or by sorting windows with places."""
        looked = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(twice, x), i)), lambda i: i.isNotNull())
        by_sort = let(
            F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
            lambda s: F.sort_array(F.filter(F.transform(s, lambda x, j: F.when((F.get(s, j - 1).h == x.h) | (F.get(s, j + 1).h == x.h), x.i)), lambda i: i.isNotNull())),
        )
        return F.when(F.size(twice) <= 16, looked).otherwise(by_sort)

    def counted(h: Column) -> Column:
        twice = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, j: F.get(s, j + 1) == x)))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(twice, lambda t: let(places(h, t), covered)))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows(words), counted))


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", refs: list[dict] | None = None) -> DataFrame:
    """docs' columns in `wl_row`, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    refs = references(docs, text, lang) if refs is None else refs
    rows = docs.select(F.struct("*").alias("wl_row"), _language(docs, lang).alias("wl_lang"), whole_text(text).alias("wl_text"))
    body = F.col("wl_text")

    known = _literal(refs)

    def own_or_any(near: Callable[[Column], Column]) -> Column:
        """Near the reference of the document's language, or else any; a language without one says nothing."""
        unknown = (F.col("wl_lang") != "") & ~F.exists(known, lambda r: r.lang == F.col("wl_lang"))
        return unknown | F.exists(known, lambda r: (r.lang == F.col("wl_lang")) & near(r)) | F.exists(known, near)

    def words_near(w: Column) -> Column:
        limit = WORD_LIMIT**2 + _noise(COMMON + 1, F.size(w))
        return (F.size(w) < LEAST_WORDS) | own_or_any(lambda r: F.pow(word_distance(w, r), 2) <= limit)

    def measured(w: Column) -> Column:
        lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.trim(x, F.lit(SPACE))) > 0)
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            _repeated(w).cast("long").alias("n_repeat_words"),
            (let(F.transform(w, F.lower), words_near) if refs else F.lit(True)).alias("words_near"),
        )

    measures = F.struct(F.length(body).cast("long").alias("wl_chars"), let(_words(body), measured).alias("wl_m"), _marks(body).alias("wl_marks"))
    # by way of explode, so that a filter on what follows does not carry copies of all this down to the scan
    rows = rows.select("wl_row", "wl_lang", F.explode(F.array(measures)).alias("wl_x")).select("wl_row", "wl_lang", "wl_x.*")
    rows = rows.select("wl_row", "wl_lang", "wl_chars", "wl_m.*", F.struct(*[c.cast("long").alias(k) for k, c in _counts(F.col("wl_marks"), F.col("wl_chars"), F.col("wl_m.word_chars")).items()]).alias("wl_n"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~failed & F.col("words_near")
    if refs:
        share = {c: F.col(f"wl_n.{c}") / F.greatest(F.col("wl_chars"), F.lit(1)) for c in CLASSES}
        limit = CHAR_LIMIT**2 + _noise(len(CLASSES), F.col("wl_chars") / 8)
        kept = kept & ((F.col("wl_chars") < LEAST_CHARS) | own_or_any(lambda r: F.pow(char_distance(share, r), 2) <= limit))
    return rows.select("wl_row", "n_words", "word_chars", F.col("wl_n.symbol").alias("n_symbols"), "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"))


def _noise(bins: int, n: Column) -> Column:
    """Room for what sampling adds to the divergence, in bits: (bins - 1) / (8 n ln 2) if all bins were alike and the
    reference as short as the text; with a long reference and few full bins it is about a quarter."""
    return (bins - 1) / (32 * math.log(2)) / F.greatest(n, F.lit(1))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    got = judged(docs.select("doc_id", "text", "lang"))
    return got.select(F.col("wl_row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
