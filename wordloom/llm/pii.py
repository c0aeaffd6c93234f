"""Personal data: base patterns, and bootstrapped contextual extraction, in DataFrame expressions alone.

Base spans (email, ip, card, phone) are the seeds. The two words before a span are its lexical pattern. All
identifier-like tokens with digits, and all that suit the shape of a kind, are candidates where no base span covers
them, with patterns of their own. Patterns and instances form a graph, stored as distinct pairs, and Spark scores it in
rounds until one adds no instance: a pattern's confidence is the share of
its distinct instances that are known to be of one kind, if there are enough of those; an instance is believed by the
patterns that precede it (noisy or) if its shape suits the kind, and then counts as known in the next round. Accepted
instances are added as spans of their kind wherever they stand as a token.

Cases: null text counts as empty; no match gives zero counts, empty spans and the SHA-256 of the empty string; rows
that repeat an id each get a row; an empty table gives no rows; any id, null too, passes through, and so do all other
columns of `scanned` and `redacted`, in `wl_row`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import FEW, salted_join, stored, whole_text
from wordloom.llm.spans import apart, digits, found, kind_spans, let, pieces, written

# Fixed patterns; each finds what the plain form of its contract finds, without walking a run of letters twice.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
#: A token with a digit or an at sign in it.
TOKEN = r"(?<![A-Za-z0-9@._/#+-])(?:[A-Za-z@._/#+-]*+[0-9]|[A-Za-z._/#+-]++@)[A-Za-z0-9@._/#+-]*+"
#: Code points before a span that hold its pattern, with the white space around its words. Two words that do not fit
#: are no pattern; none is ever cut.
LEFT = 128
#: Known instances and their share that make a pattern, belief that makes an instance.
SUPPORT, CONFIDENCE, BELIEF = 5, 0.6, 0.6
# Shapes that an unseen identifier of a kind may have.
SHAPES = {"email": r"^[^@]+@[^@]+$", "ip": r"^[0-9]{1,4}([.][0-9]{1,4}){3,5}$", "card": r"^[0-9][0-9-]{11,30}$", "phone": r"^[+]?[0-9][0-9./-]{6,22}$"}


def _luhn(number: Column) -> Column:
    back = F.reverse(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i + 1, F.lit(1)).cast("int") * (1 + i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return ~F.exists(parts, lambda p: (F.length(p) > 3) | ((F.length(p) == 3) & (p > F.lit("255"))))
    if kind == "card":
        return F.when(F.length(match) < 12, F.lit(False)).otherwise(let(digits(match), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(F.lit(False))))
    return F.length(digits(match)).between(9, 15)


def _only(kind: str, text: Column) -> Column | None:
    return {"email": text.contains("@"), "phone": text.contains("+")}.get(kind)


def _pattern(left: Column) -> Column:
    """The last two words before a span, lower case, digits as 0; empty if there are not two. `left` has one code point
    over LEFT where the text goes on before it, and then no word is taken to begin with it."""
    words = F.when(F.length(left) > LEFT, F.regexp_extract(left, r"\s(\S++\s++\S++)\s*+$", 1)).otherwise(F.regexp_extract(left, r"(?:^|\s)(\S++\s++\S++)\s*+$", 1))
    return F.regexp_replace(F.lower(F.regexp_replace(words, r"\s+", " ")), "[0-9]", "0")


def _instance(match: Column) -> Column:
    return F.regexp_replace(match, r"[._/#+@-]+$", "")


def _shaped(instance: Column) -> Column:
    return instance.rlike("|".join(SHAPES.values()))


def _base(kind: str, text: Column) -> Column:
    return F.filter(found(text, KINDS[kind], LEFT + 1, _only(kind, text)), lambda s: valid(kind, s.match))


def _seeds(kind: str) -> Column:
    return F.transform(F.col(f"wl_{kind}"), lambda s: F.struct(F.lit(kind).alias("kind"), s.match.alias("instance"), _pattern(s.left).alias("pattern")))


def located(docs: DataFrame, text: str = "text") -> DataFrame:
    """wl_row, wl_id, wl_base (spans), wl_seeds (kind, instance, pattern), wl_tokens (start, end, instance, pattern)."""
    body = F.col("wl_text")
    rows = docs.select(F.struct("*").alias("wl_row"), whole_text(text).alias("wl_text"))
    rows = rows.select("wl_row", "wl_text", *[_base(k, body).alias(f"wl_{k}") for k in KINDS])
    base = F.concat(*[kind_spans(F.col(f"wl_{k}"), k, i) for i, k in enumerate(KINDS)])
    seeds = F.concat(*[_seeds(k) for k in KINDS])
    # a shape takes 3 code points at least
    tokens = F.filter(found(body, TOKEN, LEFT + 1), lambda s: (F.length(s.match) >= 3) & (((F.length(s.match) >= 6) & (F.length(digits(s.match)) >= 4)) | _shaped(_instance(s.match))))
    tokens = F.transform(tokens, lambda s: let(_instance(s.match), lambda i: F.struct(s.start.alias("start"), (s.start + F.length(i)).alias("end"), i.alias("instance"), _pattern(s.left).alias("pattern"))))
    rows = rows.select("wl_row", *[f"wl_{k}" for k in KINDS], *[F.size(f"wl_{k}").cast("long").alias(f"n_{k}") for k in KINDS], base.alias("wl_base"), seeds.alias("wl_seeds"), tokens.alias("wl_tokens"))
    for k in KINDS:
        rows = rows.withColumn("wl_tokens", apart(F.col("wl_tokens"), F.col(f"wl_{k}")))
    return stored(rows.drop(*[f"wl_{k}" for k in KINDS]).withColumn("wl_id", F.monotonically_increasing_id()), "located")


def discovered(rows: DataFrame) -> DataFrame:
    """instance, kind: identifiers that only their contexts give away."""
    seeds = rows.select(F.explode("wl_seeds").alias("s")).select("s.pattern", "s.instance", "s.kind")
    tokens = rows.select(F.explode("wl_tokens").alias("t")).select("t.pattern", "t.instance", F.lit(None).cast("string").alias("kind"))
    pairs = stored(seeds.unionByName(tokens).groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "pattern-pairs")
    seeds = pairs.filter("kind is not null").groupBy("instance").agg(F.max("kind").alias("known"))
    graph = pairs.filter("pattern <> ''")
    new, count = None, 0
    while True:
        known = seeds if new is None else seeds.unionByName(new.join(seeds, "instance", "left_anti").select("instance", F.col("kind").alias("known")))
        scored = graph.join(known.hint("merge"), "instance", "left").groupBy("pattern").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("known") == k, 1)).alias(k) for k in KINDS])
        best = F.greatest(*[F.struct(F.col(k).alias("hits"), F.lit(k).alias("kind")) for k in KINDS])
        scored = scored.select("pattern", "n", best.alias("best")).select("pattern", F.col("best.kind").alias("of"), F.col("best.hits").alias("hits"), (F.col("best.hits") / F.col("n")).alias("confidence"))
        scored = scored.filter((F.col("hits") >= SUPPORT) & (F.col("confidence") >= CONFIDENCE))
        suits = F.coalesce(*[F.when(F.col("of") == k, F.col("instance").rlike(p)) for k, p in SHAPES.items()])
        believed = graph.filter("kind is null").join(scored, "pattern").filter(suits).groupBy("instance", "of").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("belief"))
        believed = believed.filter(F.col("belief") >= BELIEF).groupBy("instance").agg(F.max(F.struct("belief", "of")).alias("b")).select("instance", F.col("b.of").alias("kind"))
        believed = stored(believed if new is None else new.unionByName(believed.join(new, "instance", "left_anti")), "instances")
        if (n := believed.count()) == count:
            return believed
        new, count = believed, n


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """wl_row, n_email, n_ip, n_card, n_phone, base_sha256, spans, and wl_added: kind, start, end, instance of added spans."""
    rows = located(docs, text)
    tokens = rows.select("wl_id", F.explode("wl_tokens").alias("t")).select("wl_id", "t.start", "t.end", "t.instance")
    instances = discovered(rows)
    counts = tokens.groupBy("instance").agg(F.count("*").alias("places"))
    added = salted_join(tokens, stored(instances.join(counts, "instance"), "found-instances"), "instance", "places", narrow=False).groupBy("wl_id").agg(F.collect_list(F.struct("start", F.lit(len(KINDS)).alias("rank"), "end", "kind", "instance")).alias("wl_added"))
    added = stored(added, "added")
    spans = added.agg(F.sum(F.size("wl_added"))).first()[0] or 0
    rows = rows.drop("wl_seeds", "wl_tokens").join(added.hint("broadcast" if spans <= FEW else "merge"), "wl_id", "left")
    ranks = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    extra = F.coalesce(F.transform("wl_added", lambda a: F.struct(a.start.alias("start"), ranks[a.kind].alias("rank"), a.end.alias("end"), a.kind.alias("kind"))), F.slice("wl_base", 1, 0))
    return rows.select("wl_row", *[f"n_{k}" for k in KINDS], F.sha2(written(F.col("wl_base")), 256).alias("base_sha256"), written(F.concat(F.col("wl_base"), extra)).alias("spans"), "wl_added")


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each base and added span of its text put as its kind in brackets. Null texts stay null."""
    names = docs.columns
    rows = scanned(docs, text).select("wl_row", F.coalesce(F.transform("wl_added", lambda a: F.struct(a.instance.alias("instance"), a.kind.alias("kind"))), F.array().cast("array<struct<instance:string,kind:string>>")).alias("wl_added"), F.col(f"wl_row.`{text}`").cast("string").alias("wl_text"))

    def put(body: Column, pattern: str, change, only: Column | None) -> Column:
        def joined(m: Column) -> Column:
            between = pieces(body, pattern)[1]
            return F.when(F.size(m) > 0, let(between, lambda b: F.array_join(F.zip_with(b, F.transform(m, change), lambda x, y: F.concat(x, F.coalesce(y, F.lit("")))), ""))).otherwise(body)

        out = let(pieces(body, pattern)[0], joined)
        return out if only is None else F.when(only, out).otherwise(body)

    def masked(kind: str):
        return lambda x: F.when(valid(kind, x), F.lit(f"[{kind.upper()}]")).otherwise(x)

    for kind in ("email", "phone", "card", "ip") * 2:  # again for what stood against another span
        rows = rows.withColumn("wl_text", put(F.col("wl_text"), KINDS[kind], masked(kind), _only(kind, F.col("wl_text"))))

    def named(x: Column) -> Column:
        return let(_instance(x), lambda i: let(F.filter("wl_added", lambda a: a.instance == i), lambda hit: F.when(F.size(hit) > 0, F.concat(F.lit("["), F.upper(F.get(hit, F.lit(0)).kind), F.lit("]"), F.substring(x, F.length(i) + 1, F.length(x)))).otherwise(x)))

    rows = rows.withColumn("wl_text", put(F.col("wl_text"), TOKEN, named, F.size("wl_added") > 0))
    return rows.select(*[F.col("wl_text").alias(c) if c == text else F.col(f"wl_row.`{c}`").alias(c) for c in names])


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    got = scanned(docs.select("doc_id", "text"))
    return got.select(F.col("wl_row.doc_id").alias("doc_id"), *[f"n_{k}" for k in KINDS], "base_sha256", "spans")
