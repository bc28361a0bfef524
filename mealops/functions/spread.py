"""Shuffles whose number of tasks follows the input.

Adaptive execution merges shuffled parts up to a size on disk, or leaves the
session's fixed number of parts. Either way one task may sort or hash many
millions of narrow rows, and its memory follows the input. ``spread`` deals
the rows to as many tasks as the input's files have pieces of ``most`` bytes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

_SMALL = 16 << 20      # below this Spark's own choice is kept
_UNKNOWN = 1 << 40     # frames without statistics report far more


def _bytes(df: DataFrame) -> int:
    """Spark's estimate: bytes of the files, in the share of the columns that are read."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, cols: Sequence[str], read: Sequence[DataFrame], most: int = 4 << 20) -> DataFrame:
    """``df`` partitioned by ``cols`` into a task per ``most`` bytes of ``read``, the frames its rows come from.

    As it is where these are few bytes or Spark does not know them; only the number of tasks depends on it.
    """
    size = sum(_bytes(r) for r in read)
    if not _SMALL <= size < _UNKNOWN:
        return df
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // most)), *cols)
