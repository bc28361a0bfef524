"""Order-dependent helpers that stay parallel when one key is hot.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. If
one order, item or user holds a third of the rows, that task does a third of
the work alone. The helpers below split each key into *buckets* that are a
prefix of the sort order (a day, for instance):

1. the per-row work runs in ``Window.partitionBy(key, bucket)`` (many tasks);
2. one summary row per (key, bucket) is aggregated (partial aggregation
   before the shuffle, so the hot key shrinks map-side);
3. a window over the small summary carries values across buckets;
4. an equi-join on (key, bucket) puts the carried values back.

A time bucket splits a key only where its rows spread over time. ``RANGES``
splits any key, also one with a third of the rows at one instant: the rows are
range-partitioned by (key, order), with splitters that Spark samples, and the
bucket is the range. A key spans at most as many ranges as there are
partitions, so the scan over the summary stays small whatever the key holds.

Key and bucket travel as one struct, whose equality treats nulls as equal, so
rows with a null key or bucket stay, and window, summary and join share one
partitioning. Results are exactly those of the single-level window for any
input whose bucket is monotone in the order (nulls first on both).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bucket by sampled ranges of (key, order), see above.
RANGES = "__range"
_G = "__group"
_B = f"{_G}.__bucket"


def time_bucket(col: str, unit: str = "hour") -> Column:
    """A bucket that is a prefix of time order (default: the hour of ``col``)."""
    return F.date_trunc(unit, F.col(col))


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """``df`` range-partitioned by (keys, order), with the number of each row's range as ``RANGES``.

    Rows that are equal in all of these are dealt out, too, by their place in the input. The frame is
    checkpointed, so that ranges and rows stay together however often and wherever it is read.
    """
    from ..session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    d = df.withColumn("__place", F.monotonically_increasing_id())
    d = d.repartitionByRange(*[F.col(k) for k in keys], *_cols(order), F.col("__place")).drop("__place")
    return d.withColumn(RANGES, F.spark_partition_id()).checkpoint()


def _grouped(df: DataFrame, keys: list[str], order: Sequence, bucket) -> DataFrame:
    if isinstance(bucket, str) and bucket == RANGES:
        df = ranged(df, keys, order)
        return df.withColumn(_G, F.struct(*keys, F.col(RANGES).alias("__bucket"))).drop(RANGES)
    return df.withColumn(_G, F.struct(*keys, bucket.alias("__bucket")))


def _keys(keys: list[str]) -> list[Column]:
    return [F.col(f"{_G}.{k}") for k in keys]


def _cols(cs) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def prefix_sums(df: DataFrame, keys: Sequence[str], order: Sequence, bucket: Column | str | None,
                sums: dict[str, Column], seq: str | None = None) -> DataFrame:
    """Inclusive running sums of ``sums`` per key in ``order``.

    ``seq`` (optional) names a 1-based position column. ``bucket`` must be
    monotone in ``order`` (e.g. the day of the leading timestamp) or
    ``RANGES``; ``None`` uses a single-level window.
    """
    keys = list(keys)
    order_cols = _cols(order)
    all_sums = dict(sums)
    if seq:
        all_sums[seq] = F.lit(1)
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
        out = df
        for name, c in all_sums.items():
            out = out.withColumn(name, F.sum(c).over(w))
        return out
    base = _grouped(df, keys, order, bucket)
    summary = base.groupBy(_G).agg(*[F.sum(c).alias(f"__t_{n}") for n, c in all_sums.items()])
    w_in = (Window.partitionBy(_G).orderBy(*order_cols)
            .rowsBetween(Window.unboundedPreceding, 0))
    d = base.select("*", *[F.sum(c).over(w_in).alias(f"__r_{n}") for n, c in all_sums.items()])
    w_b = (Window.partitionBy(*_keys(keys)).orderBy(_B)
           .rowsBetween(Window.unboundedPreceding, -1))
    carried = summary.select(_G, *[
        F.coalesce(F.sum(f"__t_{n}").over(w_b), F.lit(0)).alias(f"__c_{n}") for n in all_sums])
    out = d.join(carried, _G)
    out = out.select("*", *[(F.col(f"__r_{n}") + F.col(f"__c_{n}")).alias(n) for n in all_sums])
    return out.drop(_G, *[f"__c_{n}" for n in all_sums], *[f"__r_{n}" for n in all_sums])


def prefix_sums_and_lows(df: DataFrame, keys: Sequence[str], order: Sequence, bucket: Column | str | None,
                         value: Column, total: str, low: str) -> DataFrame:
    """Inclusive running sum ``total`` of ``value``, and ``low``, the least sum on the rows before.

    ``low`` is NULL on the first row of a key. A bucket's summary is its sum
    and the least running sum within it; both are carried to later buckets.
    """
    keys = list(keys)
    order_cols = _cols(order)
    base = df.withColumn("__v", value)
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(*order_cols)
        out = base.withColumn(total, F.sum("__v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return out.withColumn(low, F.min(total).over(w.rowsBetween(Window.unboundedPreceding, -1))).drop("__v")
    base = _grouped(base, keys, order, bucket)
    w_in = Window.partitionBy(_G).orderBy(*order_cols)
    d = base.withColumn("__r", F.sum("__v").over(w_in.rowsBetween(Window.unboundedPreceding, 0)))
    summary = d.groupBy(_G).agg(F.sum("__v").alias("__t"), F.min("__r").alias("__m"))
    d = d.withColumn("__l", F.min("__r").over(w_in.rowsBetween(Window.unboundedPreceding, -1)))
    w_b = (Window.partitionBy(*_keys(keys)).orderBy(_B)
           .rowsBetween(Window.unboundedPreceding, -1))
    carried = (summary.withColumn("__c", F.coalesce(F.sum("__t").over(w_b), F.lit(0)))
               .withColumn("__cl", F.min(F.col("__c") + F.col("__m")).over(w_b)).select(_G, "__c", "__cl"))
    out = d.join(carried, _G)
    # least() passes over NULLs: no earlier row in the bucket, or no earlier bucket.
    out = out.select("*", (F.col("__r") + F.col("__c")).alias(total),
                     F.least(F.col("__l") + F.col("__c"), F.col("__cl")).alias(low))
    return out.drop(_G, "__v", "__r", "__l", "__c", "__cl")


def previous_values(df: DataFrame, keys: Sequence[str], order: Sequence, bucket: Column | str | None,
                    cols: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """Add ``prev_<c>`` = value of ``c`` on the previous row of the same key.

    The first row of a key gets NULLs. Two-level when ``bucket`` is given.
    """
    keys, cols = list(keys), list(cols)
    order_cols = _cols(order)
    packed = F.struct(*[F.col(c).alias(c) for c in cols])
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(*order_cols)
        p = F.lag(packed).over(w)
        return df.select("*", *[p[c].alias(prefix + c) for c in cols])
    base = _grouped(df, keys, order, bucket)
    # Last row of each (key, bucket): max_by over the full sort key.
    sort_key = F.struct(*order_cols)
    summary = base.groupBy(_G).agg(F.max_by(packed, sort_key).alias("__last"))
    w_in = Window.partitionBy(_G).orderBy(*order_cols)
    d = base.select("*", F.lag(packed).over(w_in).alias("__prev"),
                    (F.row_number().over(w_in) == 1).alias("__first"))
    w_b = Window.partitionBy(*_keys(keys)).orderBy(_B)
    carried = summary.select(_G, F.lag("__last").over(w_b).alias("__carry"))
    out = d.join(carried, _G)
    prev = F.when(F.col("__first"), F.col("__carry")).otherwise(F.col("__prev"))
    out = out.select("*", *[prev[c].alias(prefix + c) for c in cols])
    return out.drop(_G, "__prev", "__first", "__carry")


def last_non_null(df: DataFrame, keys: Sequence[str], order: Sequence, bucket: Column | str | None,
                  col: str | dict[str, str], out: str | None = None) -> DataFrame:
    """Forward fill: ``out`` = last non-null ``col`` at or before each row of a key.

    ``col`` may be a mapping {column: output} to fill several columns in one
    pass (one window, one summary aggregate, one join).
    """
    pairs = dict(col) if isinstance(col, dict) else {col: out}
    keys = list(keys)
    order_cols = _cols(order)
    if bucket is None:
        w = (Window.partitionBy(*keys).orderBy(*order_cols)
             .rowsBetween(Window.unboundedPreceding, 0))
        return df.select("*", *[F.last(c, ignorenulls=True).over(w).alias(o) for c, o in pairs.items()])
    base = _grouped(df, keys, order, bucket)
    sort_key = F.struct(*order_cols)
    summary = base.groupBy(_G).agg(*[
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), sort_key)).alias(f"__l_{o}") for c, o in pairs.items()])
    w_b = (Window.partitionBy(*_keys(keys)).orderBy(_B)
           .rowsBetween(Window.unboundedPreceding, -1))
    carried = summary.select(_G, *[
        F.last(f"__l_{o}", ignorenulls=True).over(w_b).alias(f"__c_{o}") for o in pairs.values()])
    w_in = (Window.partitionBy(_G).orderBy(*order_cols)
            .rowsBetween(Window.unboundedPreceding, 0))
    d = base.select("*", *[F.last(c, ignorenulls=True).over(w_in).alias(f"__f_{o}") for c, o in pairs.items()])
    res = d.join(carried, _G)
    res = res.select("*", *[F.coalesce(F.col(f"__f_{o}"), F.col(f"__c_{o}")).alias(o) for o in pairs.values()])
    return res.drop(_G, *[f"__f_{o}" for o in pairs.values()], *[f"__c_{o}" for o in pairs.values()])


def global_position(df: DataFrame, order: Sequence, name: str = "pos") -> DataFrame:
    """Dense 1-based position of each row in a total order, without a
    single-partition window.

    Rows are range-partitioned on the order and written once through the
    checkpoint folder (so the partitioning is fixed); per-partition counts
    (one row per partition) give each partition's offset, and a window per
    partition numbers its rows.
    """
    from ..session import checkpoint_dir
    checkpoint_dir(df.sparkSession)   # make sure a reliable checkpoint folder is registered
    order_cols = _cols(order)
    parts = df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
    pinned = parts.withColumn("__pid", F.spark_partition_id()).checkpoint(eager=True)
    counts = pinned.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    w_all = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", F.coalesce(F.sum("__n").over(w_all), F.lit(0)).alias("__off"))
    w = Window.partitionBy("__pid").orderBy(*order_cols)
    numbered = pinned.withColumn("__rn", F.row_number().over(w))
    return (numbered.join(F.broadcast(offsets), "__pid")
            .withColumn(name, F.col("__off") + F.col("__rn"))
            .drop("__pid", "__off", "__rn"))
