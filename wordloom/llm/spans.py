"""Spans of regular expressions as DataFrame expressions: where each match of a pattern stands, in code points.

Spark gives the matches of a pattern (regexp_extract_all) and the stretches between them (split), both by the same
left-to-right search; the lengths of the two, summed in turn, are the places. Sums run in blocks, so that a text with
very many matches costs little more than in proportion to them. Repeated groups in patterns are possessive: Java
walks those in a loop, and others by recursion, which a long text would drive out of its stack.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256
SPAN = "array<struct<start:int,end:int,match:string,left:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once and not again for each element of a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def sums_before(numbers: Column) -> Column:
    """For each element, the sum of those before it."""

    def blocks(n: Column) -> Column:
        count = F.ceil(F.size(n) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda b: _total(F.slice(n, b * BLOCK + 1, F.lit(BLOCK))))

    def bases(s: Column) -> Column:
        return F.transform(s, lambda _, b: _total(F.slice(s, F.lit(1), b)))

    return let(
        numbers,
        lambda n: let(
            blocks(n),
            lambda s: let(bases(s), lambda base: F.transform(n, lambda _, i: F.element_at(base, (i / BLOCK).cast("int") + 1) + _total(F.slice(n, (i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK)))),
        ),
    )


def pieces(text: Column, pattern: str) -> tuple[Column, Column]:
    """The matches of the pattern, and the stretches before, between and after them (one more)."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def found(text: Column, pattern: str, left: int = 0, only: Column | None = None) -> Column:
    """Array of (start, end, match, left): places of the pattern's matches, and up to `left` code points before each.
    only: texts that can match at all, where that is cheaper to see."""
    matches, between = pieces(text, pattern)

    def before(m: Column, s: Column, i: Column) -> Column:
        """The stretch before a match and, if that is short, the matches and stretches before it, as many as can fill it."""
        first = F.greatest(i - left, F.lit(0))
        earlier = F.zip_with(F.slice(s, first + 1, i - first), F.slice(m, first + 1, i - first), lambda a, b: F.concat(F.right(a, F.lit(left)), F.right(b, F.lit(left))))
        return F.when((i == 0) | (F.length(s[i]) >= left), F.right(s[i], F.lit(left))).otherwise(F.right(F.concat(F.array_join(earlier, ""), s[i]), F.lit(left)))

    def located(m: Column) -> Column:
        return let(
            between,
            lambda s: let(
                sums_before(F.zip_with(F.slice(s, F.lit(1), F.size(m)), m, lambda a, b: F.length(a) + F.length(b))),
                lambda at: F.transform(m, lambda x, i: F.struct((at[i] + F.length(s[i])).alias("start"), (at[i] + F.length(s[i]) + F.length(x)).alias("end"), x.alias("match"), (before(m, s, i) if left else F.lit("")).alias("left"))),
            ),
        )

    none = F.array().cast(SPAN)
    out = let(matches, lambda m: F.when(F.size(m) > 0, located(m)).otherwise(none)).cast(SPAN)
    return out if only is None else F.when(only, out).otherwise(none)


def ranks(points: Column, marks: Column, ties: bool = False) -> Column:
    """For each of the points, which ascend, the number of marks (ascending, too) below it; with ties, up to it. Both
    are sorted together, so a text with very many of both costs little more than in proportion to them."""
    own, other = F.transform(points, lambda p: F.struct(p.alias("at"), F.lit(int(ties)).alias("side"))), F.transform(marks, lambda m: F.struct(m.alias("at"), F.lit(int(not ties)).alias("side")))
    both = F.array_sort(F.concat(own, other))
    placed = F.filter(F.transform(both, lambda x, i: F.when(x.side == int(ties), i)), lambda i: i.isNotNull())
    return F.transform(placed, lambda i, k: i - k)


def apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others. Both are in order, and neither overlaps within itself."""

    def kept(s: Column, o: Column) -> Column:
        below = ranks(F.transform(s, lambda x: x.end), F.transform(o, lambda x: x.start))
        return let(below, lambda n: F.filter(s, lambda x, i: (F.get(n, i) == 0) | (F.get(o, F.get(n, i) - 1).end <= x.start)))

    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(let(spans, lambda s: let(others, lambda o: kept(s, o))))


def kind_spans(spans: Column, kind: str, rank: int) -> Column:
    """Spans as (start, rank, end, kind), which sort by start and then as the kinds are listed."""
    return F.transform(spans, lambda s: F.struct(s.start.alias("start"), F.lit(rank).alias("rank"), s.end.alias("end"), F.lit(kind).alias("kind")))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined, in order."""
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat(s.kind, F.lit(":"), s.start.cast("string"), F.lit(":"), s.end.cast("string"))), ",")


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")
