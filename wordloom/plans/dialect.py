"""One relational definition, two spellings: Spark SQL over the views of `relations`, and DuckDB over the raw tables.

A definition is a function of a dialect that returns (common table expressions, final select). Everything that differs
between the engines is a method here; the base relations are built by the DataFrame API for Spark and by SQL for DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: name -> (definition, names of base relations it reads)
DEFINITIONS: dict[str, tuple[Callable, tuple[str, ...]]] = {}


def definition(*relations: str):
    """Register a definition under its function's name."""

    def register(f: Callable) -> Callable:
        DEFINITIONS[f.__name__] = (f, relations)
        return f

    return register


def long(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def six(x: str) -> str:
    return f"ROUND(CAST({x} AS DOUBLE), 6)"


class Spark:
    def xor(self, a, b):
        return f"(({a}) ^ ({b}))"

    def shr(self, a, n):
        return f"shiftright({a}, {n})"

    def shl(self, a, n):
        return f"shiftleft(CAST({a} AS BIGINT), CAST({n} AS INT))"

    def div(self, a, b):
        return f"(({a}) div ({b}))"

    def pop(self, a):
        return f"bit_count({a})"

    def rint(self, x):
        return f"rint({x})"

    def binlen(self, a):
        return f"length(bin({a}))"

    def argmin(self, v, *keys):
        return f"min_by({v}, struct({', '.join(keys)}))"

    def numbers(self, n):
        return f"(SELECT id AS i FROM range({n}))"

    def values(self, rows, *columns):
        return f"(SELECT * FROM VALUES {rows} AS t({', '.join(columns)}))"

    def matches(self, x, p):
        return f"{x} RLIKE '{self.regex(p)}'"

    def regex(self, p):
        return p.replace("\\", "\\\\")

    def extract(self, x, p, g):
        return f"regexp_extract({x}, '{self.regex(p)}', {g})"

    def hexbyte(self, x):
        return f"lpad(lower(hex(CAST({x} AS BIGINT))), 2, '0')"

    def hexword(self, x):
        return f"lpad(lower(hex(CAST({x} AS BIGINT))), 4, '0')"

    def huffman(self, source, keys, count, name):
        """CTE body `name`: keys, and the bits of a Huffman code of the counts. At most 256 counts a group."""
        return f"{name} AS (SELECT {', '.join(keys)}, wl_huffman_bits(collect_list(CAST({count} AS BIGINT))) AS bits FROM {source} GROUP BY {', '.join(keys)})"

    def sha(self, x):
        return f"sha2(unhex({x}), 256)"

    def joined(self, x, order):
        return f"array_join(transform(array_sort(collect_list(struct({order} AS o, {x} AS v))), z -> z.v), '')"

    def explode_words(self, x):
        return f"explode(filter(split(lower({x}), '[^a-z]+'), z -> z <> ''))"

    def percentile(self, x, p):
        return f"percentile({x}, {p})"

    def median(self, x):
        return f"percentile({x}, 0.5)"

    def xor_prefix(self, x, window):
        return f"bit_xor({x}) OVER ({window} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

    def stacked(self, source, keys, rows, names):
        """Each row of the source once for each of `rows` (tuples of expressions, named `names`): one scan for all."""
        items = ", ".join("struct(" + ", ".join(f"{x} AS {n}" for x, n in zip(r, names, strict=True)) + ")" for r in rows)
        return f"SELECT {', '.join(keys)}, {', '.join(f'st.{n} AS {n}' for n in names)} FROM (SELECT {', '.join(keys)}, explode(array({items})) AS st FROM {source}) zz"

    def hash_order(self, x, seed):
        return f"((({x}) * 2654435761 + {seed}) % 4294967291)"


class Duck(Spark):
    def xor(self, a, b):
        return f"xor(CAST({a} AS BIGINT), CAST({b} AS BIGINT))"

    def shr(self, a, n):
        return f"(CAST({a} AS BIGINT) >> ({n}))"

    def shl(self, a, n):
        return f"(CAST({a} AS BIGINT) << ({n}))"

    def div(self, a, b):
        return f"(({a}) // ({b}))"

    def pop(self, a):
        return f"bit_count(CAST({a} AS BIGINT))"

    def rint(self, x):
        return f"round_even({x}, 0)"

    def argmin(self, v, *keys):
        return f"arg_min({v}, ({', '.join(keys)}{',' if len(keys) == 1 else ''}))" if len(keys) > 1 else f"arg_min({v}, {keys[0]})"

    def numbers(self, n):
        return f"(SELECT range AS i FROM range({n}))"

    def values(self, rows, *columns):
        return f"(SELECT * FROM (VALUES {rows}) AS t({', '.join(columns)}))"

    def matches(self, x, p):
        return f"regexp_matches({x}, '{p}')"

    def regex(self, p):
        return p

    def extract(self, x, p, g):
        return f"regexp_extract({x}, '{p}', {g})"

    def hexbyte(self, x):
        return f"lpad(lower(to_hex(CAST({x} AS BIGINT))), 2, '0')"

    def hexword(self, x):
        return f"lpad(lower(to_hex(CAST({x} AS BIGINT))), 4, '0')"

    def huffman(self, source, keys, count, name):
        """The two least of a list of counts go and their sum comes, until one is left; the sums are the bits."""
        own = ", ".join(keys)
        return f"{name}_q AS (SELECT {own}, list_sort(list(CAST({count} AS BIGINT))) AS q, CAST(0 AS BIGINT) AS bits FROM {source} GROUP BY {own} UNION ALL SELECT {own}, list_sort(list_append(q[3:], q[1] + q[2])), bits + q[1] + q[2] FROM {name}_q WHERE len(q) > 1), {name} AS (SELECT {own}, max(bits) AS bits FROM {name}_q GROUP BY {own})"

    def sha(self, x):
        return f"sha256(unhex({x}))"

    def joined(self, x, order):
        return f"string_agg({x}, '' ORDER BY {order})"

    def explode_words(self, x):
        return f"unnest(list_filter(string_split_regex(lower({x}), '[^a-z]+'), lambda z: z <> ''))"

    def percentile(self, x, p):
        return f"quantile_cont({x}, {p})"

    def median(self, x):
        return f"quantile_cont({x}, 0.5)"


    def stacked(self, source, keys, rows, names):
        items = ", ".join("struct_pack(" + ", ".join(f"{n} := {x}" for x, n in zip(r, names, strict=True)) + ")" for r in rows)
        return f"SELECT {', '.join(keys)}, {', '.join(f'st.{n} AS {n}' for n in names)} FROM (SELECT {', '.join(keys)}, unnest([{items}]) AS st FROM {source}) zz"


SPARK, DUCK = Spark(), Duck()

#: Base relations in DuckDB. words: one row a word, with its raster, left, upper and upper-left neighbours (null if none).
DUCK_RELATIONS = {
    "words": """wl_e AS (SELECT label AS tensor, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r FROM embeddings),
wl_f AS (SELECT tensor, vec_id, r, unnest(generate_series(0, len(embedding) - 1)) AS c, unnest(embedding) AS x FROM wl_e),
wl_b AS (SELECT *, CAST(CAST(CAST(x AS BIT) AS INTEGER) AS BIGINT) & 4294967295 AS b FROM wl_f),
wl_w AS (SELECT CAST(tensor AS BIGINT) AS tensor, vec_id, CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, CAST(x AS DOUBLE) AS x, ((b + 32767 + ((b >> 16) & 1)) >> 16) & 65535 AS w FROM wl_b),
words AS (SELECT *, lag(w) OVER (PARTITION BY tensor ORDER BY r, c) AS prev_w, lag(w) OVER (PARTITION BY tensor, r ORDER BY c) AS left_w, lag(w) OVER (PARTITION BY tensor, c ORDER BY r) AS up_w, lag(w) OVER (PARTITION BY tensor, r - c ORDER BY r) AS nw_w FROM wl_w)""",
    "documents": "",
    "conversations": "",
    "embeddings": "",
    "lineitem": "",
    "benchmark": "",
}


def render(name: str, dialect: Spark) -> str:
    f, relations = DEFINITIONS[name]
    tables, select = f(dialect)
    tables = [t for t in [DUCK_RELATIONS[r] for r in relations if dialect is DUCK] + [tables] if t]
    return (("WITH RECURSIVE " if dialect is DUCK else "WITH ") + ",\n".join(tables) + "\n" if tables else "") + select


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordloom.plans import relations

    relations.functions(spark)
    for relation in DEFINITIONS[name][1]:
        relations.view(relation, spark, sf_dir)
    return spark.sql(render(name, SPARK))


def run_on(name: str, words: DataFrame) -> DataFrame:
    """A definition over words of any source (relations.spread), rather than over the tables of a folder."""
    from wordloom.plans import relations

    spark = words.sparkSession
    if DEFINITIONS[name][1] != ("words",):
        raise ValueError(f"{name} is not about words")
    relations.functions(spark)
    words.createOrReplaceTempView("words")
    return spark.sql(render(name, SPARK))
