"""The query catalogue: one Spark query and one SQL oracle per operator key.

A Spark query takes the bound frames of one data directory
(``mealops.sources.bind.Bound``) and returns a DataFrame; its fixed
parameters (dates, codes, limits) are part of the entry. The oracle is the
same question in DuckDB SQL over the raw tables, with the bindings as CTEs.
Entries without an oracle are checked on row counts only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.bind import Bound
from .oracle_bindings import with_bindings

QUERIES: dict[str, Callable[[Bound], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _decimals_to_double(df: DataFrame) -> DataFrame:
    """Report money and macros as double (exact decimals are kept inside)."""
    if not any(isinstance(f.dataType, T.DecimalType) for f in df.schema.fields):
        return df
    return df.select(*[F.col(f.name).cast("double").alias(f.name)
                       if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
                       for f in df.schema.fields])


def register(name: str, sql: str | None = None, recursive: bool = False):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda b: _decimals_to_double(fn(b))
        if sql is not None:
            text = with_bindings(sql)
            ORACLES[name] = text.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else text
        return fn
    return deco


def _load_all() -> None:
    # Importing the modules fills the registries.
    from . import queries_core, queries_io, queries_menu_promo, queries_reports, queries_streams  # noqa: F401


_load_all()
