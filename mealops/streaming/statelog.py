"""A keyed state table that is updated, not rewritten.

A micro-batch writes only its changed rows, to ``batch_id=<n>``. Every
``compact_every`` batches the newest rows of all keys are written once, to
``snapshot_id=<n>``, so a read takes one snapshot and fewer than
``compact_every`` further folders, and the cost of the snapshots is spread
over the batches between them. Folders that no replay can ask for are removed.

Batch n reads the versions before n and overwrites its own folders, so a
replayed batch gives the same rows. A folder that should be there and is not
raises an error.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

_STEP = "__batch"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class StateLog:
    """``schema``: key columns and values; one row per key and version."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: StructType, compact_every: int = 16):
        if compact_every < 2:
            raise ValueError("compact_every must be 2 at least")
        self.spark, self.path, self.keys, self.schema, self.every = spark, path, list(keys), schema, compact_every

    def _folder(self, kind: str, n: int) -> str:
        return os.path.join(self.path, f"{kind}={n}")

    def _snapshot_before(self, batch_id: int) -> int | None:
        """The last snapshot of a batch before ``batch_id`` (they are at fixed places)."""
        n = batch_id // self.every * self.every - 1
        return n if n >= 0 else None

    def before(self, batch_id: int) -> DataFrame:
        """The newest row of every key that a batch before ``batch_id`` has written."""
        return self._newest(self._snapshot_before(batch_id), batch_id)

    def _newest(self, snap: int | None, stop: int) -> DataFrame:
        """The newest rows over a snapshot and the batches after it, up to ``stop``."""
        parts = [self._read("snapshot_id", snap)] if snap is not None else []
        parts += [self._read("batch_id", n) for n in range(0 if snap is None else snap + 1, stop)]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        rest = [c for c in self.schema.names if c not in self.keys]
        newest = out.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), _STEP).alias("__v"))
        return newest.select(*[F.col(f"__v.{c}").alias(c) if c in rest else F.col(c) for c in self.schema.names])

    def _read(self, kind: str, n: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self._folder(kind, n)).withColumn(
            _STEP, F.lit(n).cast(LongType()))

    def write(self, batch_id: int, changed: DataFrame) -> None:
        """Store the changed rows of a batch; compact at every ``compact_every``-th one."""
        changed.select(*self.schema.names).write.mode("overwrite").parquet(self._folder("batch_id", batch_id))
        if (batch_id + 1) % self.every:
            return
        snap = self._snapshot_before(batch_id)
        self._newest(snap, batch_id + 1).write.mode("overwrite").parquet(self._folder("snapshot_id", batch_id))
        # A replay of this batch reads the snapshot before it and what follows; older folders are done with.
        if snap is not None:
            jvm_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
            old = [self._folder("batch_id", n) for n in range(max(0, snap - self.every + 1), snap + 1)]
            old.append(self._folder("snapshot_id", snap - self.every))
            for folder in old:
                _fs(self.spark, folder).delete(jvm_path(folder), True)
