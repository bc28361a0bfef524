"""Helpers shared by the operators: shared scratch folders, Arrow batches."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: Words and stripped margins: ASCII white space only (fixed by the contracts).
SPACE = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir`` (shared by all machines)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_small(table: DataFrame, most: int = 8 << 20) -> DataFrame:
    """A written table, with a broadcast hint if its files hold at most ``most`` bytes.

    Beyond that the join is left to Spark (a shuffled join, split where a key is hot).
    """
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(table) if size <= most else table


def text_of(df: DataFrame, text_col: str = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(df[text_col].cast("string"), F.lit(""))


def rows_named(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns cannot clash with ours."""
    return df.select(*[df[n] for n in names])


def worker_state(key, make: Callable):
    """``make()``, kept in this Python worker for later tasks of the same key.

    Functions of this package reach a worker pickled by value, each time with globals of their own; a module in
    ``sys.modules`` outlives them (Spark reuses workers).
    """
    kept = sys.modules.setdefault("mealops_worker_state", types.ModuleType("mealops_worker_state")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]
