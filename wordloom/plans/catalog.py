"""All queries of the tensor-word engine, and their DuckDB spelling."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from wordloom.operators import archive, batched, codecs, costs, delta, fields, menu, models, quant, solvers, spatial, stats, variants, windows  # noqa: F401  these register their definitions
from wordloom.plans import dialect


#: Modules with queries of their own, and their DuckDB spelling where there is one; those of `batched` stand for a
#: definition of the same name, which DuckDB keeps.
MODULES = (batched, codecs, solvers, archive, spatial, models, delta)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: partial(dialect.run, name) for name in dialect.DEFINITIONS}
    for module in MODULES:
        out |= module.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out = {name: dialect.render(name, dialect.DUCK) for name in dialect.DEFINITIONS}
    for module in MODULES:
        out |= getattr(module, "ORACLES", {})
    return out
