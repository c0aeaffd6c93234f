"""Secret scan with linking of multipart credentials, in DataFrame expressions alone.

Strong kinds stand by themselves: `assign` (a keyword that is given a value), `access` and `hex`. Weak parts say little
alone: `id` (a capital-letter-and-digit identifier or the value of an account field), `secret` (a long mixed token or
the value of a pass or key field) and `endpoint` (a URL or host field). All parts of a text are sorted by place and
joined by interval: two parts meet if they lie in one scope (no blank line between them) within REACH code points. The
parts of a kind do not overlap, so a part is joined with the last of each other kind before it and the first after it,
which are found by sorting both together. A
weak secret is reported if an id or endpoint (or `access`) meets it; a weak id if a secret (weak, `assign` or `hex`)
meets it; an endpoint if a secret and an id meet it.

Cases: null text counts as empty; no match gives zero counts, empty spans and the SHA-256 of the empty string; rows
that repeat an id each get a row; an empty table gives no rows; any id, null too, passes through. Other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import whole_text
from wordloom.llm.spans import apart, found, kind_spans, let, ranks, written

# Fixed patterns of the strong kinds; possessive forms match what the plain ones match.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
#: Weak parts: role, pattern. A part runs to the end of its token, however long.
WEAK = {
    "id": r"""(?<![A-Za-z0-9])(?=[A-Z]*+[0-9])(?=[0-9]*+[A-Z])[A-Z0-9]{12,}+(?![A-Za-z0-9])|(?i:user(?:name)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}+""",
    "secret": r"""(?<![A-Za-z0-9+/_-])(?=[^a-z\s]{0,40}[a-z]|[A-Z0-9+/_-]*+[a-z])(?=[^A-Z\s]{0,40}[A-Z]|[a-z0-9+/_-]*+[A-Z])(?=[^0-9\s]{0,40}[0-9]|[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_-])|(?i:pwd|pass|passphrase|auth|credentials?|private_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=!@#$%^&*-]{6,}+""",
    "endpoint": r"""(?i:https?|wss?|s?ftp|ssh|jdbc:[a-z]{2,12}|postgres(?:ql)?|mysql|redis|mongodb(?:\+srv)?|amqps?)://[^\s"'<>]{3,}+|(?i:host(?:name)?|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:-]{3,}+""",
}
KINDS = ["assign", "access", "hex", "id", "secret", "endpoint"]
#: What a weak part must meet: one of each group.
MEETS = {"id": [["assign", "hex", "secret"]], "secret": [["access", "id", "endpoint"]], "endpoint": [["assign", "hex", "secret"], ["access", "id"]]}
#: Code points between two parts that meet; the fewest code points of a part.
REACH, LEAST = 240, 6


def _strong(text: Column) -> dict[str, Column]:
    assign = F.filter(found(text, ASSIGN), lambda s: F.length(F.regexp_extract(s.match, ASSIGN, 1)) >= 6)
    return {"assign": assign, "access": found(text, ACCESS, only=text.contains("AKIA")), "hex": found(text, HEX)}


def _near(parts: Column, others: Column, breaks: Column) -> Column:
    """For each part, whether one of the others, none of which overlap, lies in its scope within the reach: the last
    that ends before it or the first that starts after it, since all others of their side are farther away."""

    def measured(p: Column, o: Column) -> Column:
        starts, ends = F.transform(p, lambda x: x.start), F.transform(p, lambda x: x.end)
        own = ranks(starts, breaks)
        scopes = ranks(F.transform(o, lambda x: x.start), breaks)
        before = ranks(starts, F.transform(o, lambda x: x.end), ties=True)
        after = ranks(ends, F.transform(o, lambda x: x.start))

        def told(m: Column) -> Column:
            def meets(x: Column, i: Column) -> Column:
                b, a = F.get(m.before, i) - 1, F.get(m.after, i)
                scope = F.get(m.own, i)
                left = (b >= 0) & (F.get(m.scopes, b) == scope) & (x.start - F.get(o, b).end <= REACH)
                right = (F.get(m.scopes, a) == scope) & (F.get(o, a).start - x.end <= REACH)
                return F.coalesce(left, F.lit(False)) | F.coalesce(right, F.lit(False))

            return F.transform(p, meets)

        return let(F.struct(own.alias("own"), scopes.alias("scopes"), before.alias("before"), after.alias("after")), told)

    none = F.transform(parts, lambda _: F.lit(False))
    return F.when((F.size(parts) == 0) | (F.size(others) == 0), none).otherwise(let(parts, lambda p: let(others, lambda o: measured(p, o))))


def _linked(parts: dict[str, Column], breaks: Column) -> Column:
    """The weak parts that complementary parts meet, as kind_spans."""
    ends = F.transform(breaks, lambda b: b.start)
    out = []
    for kind, needs in MEETS.items():
        own = parts[kind]
        groups = []
        for roles in needs:
            near = [_near(own, parts[r], ends) for r in roles]
            any_of = near[0]
            for other in near[1:]:
                any_of = F.zip_with(any_of, other, lambda x, y: x | y)
            groups.append(any_of)
        hit = groups[0]
        for other in groups[1:]:
            hit = F.zip_with(hit, other, lambda x, y: x & y)
        out.append(kind_spans(_picked(own, hit), kind, KINDS.index(kind)))
    return F.concat(*out)


def _picked(spans: Column, which: Column) -> Column:
    return let(which, lambda w: F.filter(spans, lambda _, i: F.get(w, i)))


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' columns in `wl_row`, with n_assign, n_access, n_hex, base_sha256 and spans."""
    rows = docs.select(F.struct("*").alias("wl_row"), whole_text(text).alias("wl_text"))
    strong = _strong(F.col("wl_text"))
    rows = rows.select("wl_row", "wl_text", F.struct(*[v.alias(k) for k, v in strong.items()]).alias("wl_strong"))
    rows = rows.withColumn("wl_weak", F.struct(*[F.filter(found(F.col("wl_text"), p), lambda s: F.length(s.match) >= LEAST).alias(k) for k, p in WEAK.items()]))
    base = F.concat(*[kind_spans(F.col(f"wl_strong.{k}"), k, KINDS.index(k)) for k in strong])
    counts = {f"n_{k}": F.size(f"wl_strong.{k}").cast("long") for k in strong}
    rows = rows.select("wl_row", "wl_text", *[c.alias(n) for n, c in counts.items()], base.alias("wl_base"), "wl_strong", "wl_weak")
    for k in strong:  # a weak part that overlaps a strong one says nothing more
        rows = rows.withColumn("wl_weak", F.struct(*[apart(F.col(f"wl_weak.{w}"), F.col(f"wl_strong.{k}")).alias(w) for w in WEAK]))
    some = F.size("wl_weak.id") + F.size("wl_weak.secret") + F.size("wl_weak.endpoint") > 0
    rows = rows.withColumn("wl_breaks", found(F.col("wl_text"), r"\n[\x20\t\r]*+\n", only=some & F.col("wl_text").contains("\n")))
    parts = {k: F.col(f"wl_strong.{k}") for k in strong} | {k: F.col(f"wl_weak.{k}") for k in WEAK}
    added = F.when(some, _linked(parts, F.col("wl_breaks"))).otherwise(F.slice("wl_base", 1, 0))
    return rows.select("wl_row", *counts, F.sha2(written(F.col("wl_base")), 256).alias("base_sha256"), written(F.concat(F.col("wl_base"), added)).alias("spans"))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    got = scanned(docs.select("doc_id", "text"))
    return got.select(F.col("wl_row.doc_id").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans")
