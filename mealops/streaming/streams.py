"""Structured Streaming versions of the order, delivery and stock events.

Every transformation here is a function over a DataFrame that works the
same on a static frame (the batch twin, used for checks) and on a streaming
one. The folds that Spark SQL cannot state across micro-batches (rate limiting,
the previous status of an order) use ``applyInPandasWithState`` with O(1)
state per key; low-stock crossings fold each micro-batch with Spark SQL
against a log of per-item states. The batch twins are Spark SQL.
"""

from __future__ import annotations

import os
import sys
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.rules import ntz_micros
from ..operators.orders import STAGES, status_transitions
from ..operators.stock import bom_explosion
from ..sources.schemas import RAW
from .statelog import StateLog

# ----------------------------------------------------------------- sources


def read_events_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """The ``events`` table as a stream; ``ts`` cast to a session-zone timestamp."""
    e = read_table_stream(spark, sf_dir, "events", max_files)
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def read_table_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """A table as a file stream.

    A directory ``<name>.parquet/`` is streamed as is (new part files arrive
    as new micro-batches); a single ``<name>.parquet`` file is picked out of
    its folder with a file-name filter.
    """
    path = os.path.join(sf_dir, f"{name}.parquet")
    r = spark.readStream.schema(RAW[name])
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    if os.path.isfile(path):
        return r.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return r.parquet(path)


def status_events_of(events: DataFrame) -> DataFrame:
    et = F.col("event_type")
    return events.select(
        "event_id", F.col("user_id").alias("order_id"),
        F.when(et == "signup", "pending").when(et == "view", "confirmed").when(et == "click", "preparing")
         .when(et == "purchase", "ready").otherwise("cancelled").alias("status"), "ts")


def pings_of(events: DataFrame) -> DataFrame:
    eid = F.col("event_id")
    return events.select(
        "event_id", F.col("user_id").alias("order_id"), (eid % 10).alias("shipper_id"),
        (F.lit(10) + F.col("value").cast("decimal(10,2)") * F.lit(0.001).cast("decimal(4,3)"))
        .cast("decimal(10,7)").alias("latitude"),
        (F.lit(106) + (eid % 1000).cast("decimal(4,0)") * F.lit(0.0001).cast("decimal(5,4)"))
        .cast("decimal(10,7)").alias("longitude"),
        F.col("ts").alias("recorded_at"))


# ----------------------------------------------------- stateless / built-in

def order_stream(status_events: DataFrame) -> DataFrame:
    """New orders entering the kitchen queue (``new_order`` payloads), append mode."""
    return (status_events.filter(F.col("status") == "pending")
            .select(F.col("order_id").alias("id"), F.lit("online").alias("type"),
                    F.col("status"), F.col("ts").alias("arrived_at"), "event_id"))


def order_status_stream(status_events: DataFrame) -> DataFrame:
    """Latest status per order and the first time each stage was reached (update mode)."""
    return status_events.groupBy("order_id").agg(
        F.max_by("status", F.struct("ts", "event_id")).alias("status"),
        F.max("ts").alias("updated_at"),
        *[F.min(F.when(F.col("status") == s, F.col("ts"))).alias(f"{s}_at") for s in STAGES])


def shipper_position_stream(pings: DataFrame) -> DataFrame:
    """Latest position per (order, shipper) (update mode)."""
    return pings.groupBy("order_id", "shipper_id").agg(
        F.max_by(F.struct("latitude", "longitude", "recorded_at"), F.struct("recorded_at", "event_id")).alias("p")
    ).select("order_id", "shipper_id", "p.latitude", "p.longitude", "p.recorded_at")


# Socket rooms per event type ("order-" rooms get the order id).
ROUTES = {"new_order": ["kitchen"], "order_status_update": ["customer", "order-"],
          "shipper_location": ["order-"], "pickup_ready": ["shipper"], "inventory_updated": ["admin"]}
# Our mapping of the driver's event types onto the socket events.
EVENT_OF = {"signup": "new_order", "view": "order_status_update", "click": "shipper_location",
            "purchase": "pickup_ready", "error": "inventory_updated"}


def event_fanout(events: DataFrame) -> DataFrame:
    """One row per (event, target room): a fixed routing map + explode (no join needed)."""
    ev = F.create_map(*[x for k, v in EVENT_OF.items() for x in (F.lit(k), F.lit(v))])
    rooms = F.create_map(*[x for k, v in ROUTES.items()
                           for x in (F.lit(k), F.array(*[F.lit(r) for r in v]))])
    e = events.select("event_id", "user_id", ev[F.col("event_type")].alias("event"))
    r = e.select("event_id", "event", F.explode(rooms[F.col("event")]).alias("room"), "user_id")
    room = F.when(F.col("room") == "order-", F.concat(F.lit("order-"), F.col("user_id").cast("string"))) \
        .otherwise(F.col("room"))
    return r.select("event_id", "event", room.alias("room"))


def recent_events(events: DataFrame, *, length: str = "30 seconds", slide: str = "10 seconds",
                  watermark: str | None = None) -> DataFrame:
    """Event counts per sliding window and type (the last-30-seconds feed).

    Windows are taken on wall-clock time (``timestamp_ntz``), so they do not
    move with the session time zone; only a watermark needs a ``timestamp``.
    """
    if watermark:
        e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    else:
        e = events.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return (e.groupBy(F.window("ts", length, slide).alias("w"), "event_type")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"), "event_type", "n"))


# --------------------------------------------------------------- stateful

RATE_SCHEMA = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()), T.StructField("count", T.LongType()),
    T.StructField("remaining", T.LongType()), T.StructField("blocked", T.BooleanType())])


def _rate_fold(rows: pd.DataFrame, state: tuple | None, window_us: int, limit: int):
    """Fold one key's requests (sorted) from ``state`` = (count, reset_us)."""
    count, reset = state if state is not None else (0, None)
    out_count, out_rem, out_block = [], [], []
    for t in rows["_us"].to_numpy():
        if reset is None:
            reset = int(t) + window_us
        if t > reset:
            count, reset = 0, int(t) + window_us
        count += 1
        out_count.append(count)
        out_rem.append(max(0, limit - count))
        out_block.append(count > limit)
    res = pd.DataFrame({"key": rows["key"].to_numpy(), "event_id": rows["event_id"].to_numpy(),
                        "ts": rows["ts"].to_numpy(), "count": out_count, "remaining": out_rem,
                        "blocked": out_block})
    return res, (count, reset)


def _requests(events: DataFrame, key_col: str) -> DataFrame:
    return events.select(F.col(key_col).cast("string").alias("key"), "event_id",
                         F.col("ts").cast("timestamp_ntz").alias("ts"),
                         ntz_micros(F.col("ts").cast("timestamp_ntz")).alias("_us"))


RATE_BLOCK = "key string, range int, first long, n long, entry binary, reset binary, count binary"


def _window_starts(us: np.ndarray, window_us: int) -> np.ndarray:
    """For every request as the start of a window: the start of the last window that its chain opens here.

    The next window opens at the first request after start + window; the chains of all starts are followed
    together, by jumps of doubled length.
    """
    jump = np.searchsorted(us, us + window_us, side="right")
    last = np.arange(len(us))
    jump = np.append(jump, len(us))
    while True:
        on = jump[:-1] < len(us)
        if not on.any():
            return last
        last = np.where(on, last[np.minimum(jump[:-1], len(us) - 1)], last)
        jump[:-1] = jump[jump[:-1]]


def _blocks(batches):
    """Runs of one key in sorted Arrow batches -> (key, range, columns of the run)."""
    held, at = [], None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        ids = np.asarray(batch.column(batch.schema.names.index("key")).dictionary_encode(null_encoding="encode").indices)
        cuts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1], True])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            run = t.slice(a, b - a)
            key = (run.column("key")[0].as_py(), run.column("range")[0].as_py())
            if held and key != at:
                yield *at, pa.concat_tables(held)
                held = []
            at = key
            held.append(run)
    if held:
        yield *at, pa.concat_tables(held)


def _rate_maps(window_us: int):
    """Sorted requests of a range -> what its first and its last key make of a window that is open before them.

    A block (a key's requests in a range) turns an open window that ends at x into the window open after it.
    Requests up to x belong to the open window; the first one after x, request i, starts the next. ``entry`` holds
    the requests' times, ``reset`` and ``count`` the end of the last window that is opened from request i on, and
    its requests. Only requests within a window's length of the first one, and the next, can be request i.
    """
    def run(batches):
        first, last = None, None
        for block in _blocks(batches):
            if first is None:
                first = block
            last = block
        for key, part, t in ([] if first is None else [first] if first is last else [first, last]):
            us = t.column("_us").to_numpy()
            m = min(len(us), int(np.searchsorted(us, us[0] + window_us, side="right")) + 1)
            start = _window_starts(us, window_us)[:m]
            yield pa.record_batch([pa.array([key], pa.string()), pa.array([part], pa.int32()),
                                   pa.array([int(us[0])], pa.int64()), pa.array([len(us)], pa.int64()),
                                   pa.array([us[:m].astype("<i8").tobytes()], pa.binary()),
                                   pa.array([(us[start] + window_us).astype("<i8").tobytes()], pa.binary()),
                                   pa.array([(len(us) - start).astype("<i8").tobytes()], pa.binary())],
                                  names=["key", "range", "first", "n", "entry", "reset", "count"])

    return run


def _rate_carry(batches):
    """Maps sorted by (key, range) -> the window (reset, count) that is open before each block; null: none."""
    at, reset, count = object(), None, 0
    for batch in batches:
        keys, parts, resets, counts = [], [], [], []
        for r in batch.to_pylist():
            if r["key"] != at:
                at, reset, count = r["key"], None, 0
            keys.append(r["key"])
            parts.append(r["range"])
            resets.append(reset)
            counts.append(count)
            us = np.frombuffer(r["entry"], "<i8")
            i = 0 if reset is None else int(np.searchsorted(us, reset, side="right"))
            if i < len(us):
                reset = int(np.frombuffer(r["reset"], "<i8")[i])
                count = int(np.frombuffer(r["count"], "<i8")[i])
            else:
                count += r["n"]
        yield pa.record_batch([pa.array(keys, pa.string()), pa.array(parts, pa.int32()), pa.array(resets, pa.int64()),
                               pa.array(counts, pa.int64())], names=["key", "range", "reset", "before"])


def _rate_counts(window_us: int, limit: int):
    """Sorted requests with the window open before their block -> their counts."""
    def run(batches):
        for key, _, t in _blocks(batches):
            us = t.column("_us").to_numpy()
            reset, before = t.column("reset")[0].as_py(), t.column("before")[0].as_py()
            i = 0 if reset is None else int(np.searchsorted(us, reset, side="right"))
            starts = np.zeros(len(us), bool)
            at = i
            while at < len(us):                                # one step a window
                starts[at] = True
                at = int(np.searchsorted(us, us[at] + window_us, side="right"))
            place = np.arange(len(us))
            count = place - np.maximum.accumulate(np.where(starts, place, -1)) + 1
            count[:i] = (before or 0) + place[:i] + 1
            yield pa.record_batch([t.column("key").combine_chunks().cast(pa.string()), t.column("event_id").combine_chunks(),
                                   t.column("ts").combine_chunks(), pa.array(count, pa.int64()),
                                   pa.array(np.maximum(limit - count, 0), pa.int64()), pa.array(count > limit)],
                                  names=RATE_SCHEMA.fieldNames())
    return run


def rate_limit_violations(events: DataFrame, *, key_col: str = "user_id", window_ms: int = 60_000,
                          limit: int = 10) -> DataFrame:
    """Batch rate limiter, exact and parallel even for one hot key, with one shuffle of the requests.

    Windows open at a key's first request; the next window opens at the
    first request after start + window, so window starts form a chain.

    1. Requests are range-partitioned by (key, time, event), so a hot key is
       many blocks; the ranges are checkpointed.
    2. Only the first and the last key of a range can have requests in other
       ranges. For these a block becomes a function: from the end of the
       window that is open before it to the window open after it, as a step
       function over the requests that can be its first window start. All
       chains of a block are followed at once.
    3. One scan over these functions (two a range at most) composes them in
       order and tells each block the window it begins in.
    4. Every block counts its requests from there.

    A block's times are held by its task (8 bytes a request), a function's
    steps by the scan, one function at a time. A null key is a key like any
    other.
    """
    from ..functions.windows import RANGES, ranged
    w_us = window_ms * 1000
    r = ranged(_requests(events, key_col), ["key"], ["_us", "event_id"]).withColumnRenamed(RANGES, "range")
    order = ["key", "_us", "event_id"]                         # within the ranges, which stay as they are
    maps = r.sortWithinPartitions(*order).select("key", "range", "_us").mapInArrow(_rate_maps(w_us), RATE_BLOCK)
    carried = (maps.repartition("key").sortWithinPartitions("key", "range")
               .mapInArrow(_rate_carry, "key string, range int, reset long, before long").checkpoint())
    # Two rows a partition at most, each with a key: bounded by the number of partitions, not by the requests.
    c = F.broadcast(carried.withColumnsRenamed({"key": "_k", "range": "_r"}))
    told = r.join(c, F.col("key").eqNullSafe(F.col("_k")) & (F.col("range") == F.col("_r")), "left")
    return (told.select("key", "range", "event_id", "ts", "_us", "reset", "before").sortWithinPartitions(*order)
            .mapInArrow(_rate_counts(w_us, limit), RATE_SCHEMA))


def rate_limit_stream(events: DataFrame, *, key_col: str = "user_id", window_ms: int = 60_000,
                      limit: int = 10, watermark: str = "10 minutes") -> DataFrame:
    """Streaming rate limiter: ``applyInPandasWithState`` with (count, reset) per key.

    A key's state expires by event time once the watermark passes its
    window end (the reference's periodic cleanup); a request after the
    window starts a new one either way, so expiry never changes a count.
    """
    window_us = window_ms * 1000
    r = _requests(events, key_col).withColumn("wm", F.col("ts").cast("timestamp")).withWatermark("wm", watermark)

    def step(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        st = state.get if state.exists else None
        rows = pd.concat(list(pdfs), ignore_index=True).sort_values(["_us", "event_id"])
        res, new = _rate_fold(rows, st, window_us, limit)
        state.update(new)
        state.setTimeoutTimestamp(int(new[1] // 1000) + 1)
        yield res

    return r.groupBy("key").applyInPandasWithState(
        step, RATE_SCHEMA, "count long, reset long", "append", GroupStateTimeout.EventTimeTimeout)


# The folds above run in Python workers: they travel with their code, so workers need no copy of
# this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_LEDGER_SORT = ["created_at", "order_id", "line_no", "action_type", "quantity_change"]


def _path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def low_stock_batch(batch: DataFrame, state: DataFrame, inventory: DataFrame, keep=None) -> tuple[DataFrame, DataFrame]:
    """One micro-batch of ledger rows against the per-item stock state.

    Returns (crossing alerts, new state). Running sums inside the batch use
    the two-level window helper, so a hot item is split by day; the state
    is one row per item (qty before the batch). Only ``low_stock_floored_batch``
    uses ``keep``.
    """
    from ..functions.windows import prefix_sums, time_bucket
    run = prefix_sums(batch, ["inventory_id"], _LEDGER_SORT, time_bucket("created_at"),
                      {"run": F.col("quantity_change")})
    mins = inventory.select("inventory_id", "min_quantity")
    j = run.join(state, "inventory_id").join(mins, "inventory_id")
    after = F.col("qty") + F.col("run")
    before = after - F.col("quantity_change")
    alerts = (j.select("inventory_id", "order_id", "line_no", "created_at",
                       before.alias("before"), after.alias("after"), "min_quantity")
              .filter((F.col("before") > F.col("min_quantity")) & (F.col("after") <= F.col("min_quantity")))
              .select("inventory_id", "order_id", "line_no", "created_at",
                      F.col("before").cast("double").alias("before"), F.col("after").cast("double").alias("after")))
    delta = batch.groupBy("inventory_id").agg(F.sum("quantity_change").alias("d"))
    new_state = (state.join(delta, "inventory_id", "left")
                 .select("inventory_id", (F.col("qty") + F.coalesce("d", F.lit(0))).cast("decimal(18,2)").alias("qty")))
    return alerts, new_state


def low_stock_floored_batch(batch: DataFrame, state: DataFrame, inventory: DataFrame, keep=lambda df: df
                            ) -> tuple[DataFrame, DataFrame]:
    """``low_stock_batch`` with stock, and so the state, floored at 0 after every ledger row.

    Both results read the running sums: ``keep`` may persist them.
    """
    from ..functions.windows import prefix_sums_and_lows, time_bucket
    from ..operators.stock import floored
    # Years: an item's hours hold hardly more than a row each, so their summary would be as long as the batch.
    run = keep(prefix_sums_and_lows(batch, ["inventory_id"], _LEDGER_SORT, time_bucket("created_at", "year"),
                                    F.col("quantity_change"), "run", "low"))
    mins = inventory.select("inventory_id", "min_quantity")
    j = run.join(state, "inventory_id").join(mins, "inventory_id")
    before = floored(F.col("qty"), F.col("run") - F.col("quantity_change"), F.col("low"))
    after = floored(F.col("qty"), F.col("run"), F.least("low", "run"))
    alerts = (j.select("inventory_id", "order_id", "line_no", "created_at",
                       before.alias("before"), after.alias("after"), "min_quantity")
              .filter((F.col("before") > F.col("min_quantity")) & (F.col("after") <= F.col("min_quantity")))
              .select("inventory_id", "order_id", "line_no", "created_at",
                      F.col("before").cast("double").alias("before"), F.col("after").cast("double").alias("after")))
    delta = run.groupBy("inventory_id").agg(F.sum("quantity_change").alias("d"), F.min("run").alias("m"))
    after_batch = floored(F.col("qty"), F.coalesce("d", F.lit(0)), F.col("m"))
    new_state = (state.join(delta, "inventory_id", "left")
                 .select("inventory_id", after_batch.cast("decimal(18,2)").alias("qty")))
    return alerts, new_state


def low_stock_alert_stream(ledger: DataFrame, inventory: DataFrame, out_dir: str, state_dir: str,
                           checkpoint: str, *, fold=low_stock_batch, compact_every: int = 16):
    """Start the low-stock crossing stream (``foreachBatch`` + a log of changed items).

    State = last quantity per item, kept by ``StateLog``: batch n reads the
    newest quantities of its own items (the inventory's opening stock where
    there is none yet), and writes its alerts (``out_dir/batch_id=<n>``) and
    the quantities of the items it changed, both in overwrite mode, so a
    replayed batch is idempotent. Everything runs as Spark SQL: no Python per
    row or per key. ``fold`` is the step per micro-batch
    (``low_stock_floored_batch`` floors stock at 0).
    """
    opening = inventory.select("inventory_id", F.col("quantity").cast("decimal(18,2)").alias("opening"))
    schema = T.StructType([inventory.schema["inventory_id"], T.StructField("qty", T.DecimalType(18, 2))])

    def sink(df, batch_id):
        log = StateLog(df.sparkSession, state_dir, ["inventory_id"], schema, compact_every)
        kept = []

        def keep(frame):
            kept.append(frame.persist())
            return kept[-1]

        df = keep(df)   # read by the running sums, the items in scope and the state delta
        try:
            items = df.select("inventory_id").distinct()
            state = (opening.join(items, "inventory_id", "left_semi").join(log.before(batch_id), "inventory_id", "left")
                     .select("inventory_id", F.coalesce("qty", "opening").alias("qty")))
            alerts, changed = fold(df, state, inventory, keep)
            alerts.write.mode("overwrite").parquet(os.path.join(out_dir, f"batch_id={batch_id}"))
            log.write(batch_id, changed)
        finally:
            for frame in kept:
                frame.unpersist()

    return (ledger.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


KEPT_ORDER = T.StructType([T.StructField("order_id", T.LongType()), T.StructField("version", T.LongType()),
                           T.StructField("day", T.DateType()), T.StructField("status", T.StringType()),
                           T.StructField("total", T.DecimalType(18, 2)), T.StructField("discount", T.DecimalType(18, 2))])
KEPT_DAY = T.StructType([T.StructField("report_date", T.DateType()), T.StructField("total_orders", T.LongType()),
                         T.StructField("total_revenue", T.DecimalType(28, 2)),
                         T.StructField("total_discount", T.DecimalType(28, 2))])


def _shares(orders: DataFrame, sign: int) -> DataFrame:
    """What orders add to their day (or take from it): nothing where they are cancelled."""
    return orders.filter(F.col("status") != "cancelled").select(
        F.col("day").alias("report_date"), F.lit(sign).cast("long").alias("n"),
        (F.col("total") * sign).cast("decimal(28,2)").alias("t"), (F.col("discount") * sign).cast("decimal(28,2)").alias("d"))


def order_changes(batch: DataFrame, known: DataFrame) -> DataFrame:
    """(order_id, new, old) of the orders that a micro-batch of order versions changes.

    Of an order's versions the highest counts, whenever it comes.
    """
    rest = [c for c in KEPT_ORDER.names if c != "order_id"]
    newest = batch.groupBy("order_id").agg(F.max_by(F.struct(*rest), "version").alias("new"))
    old = known.select("order_id", F.struct(*rest).alias("old"))
    return newest.join(old, "order_id", "left").where(
        F.col("old").isNull() | (F.col("new.version") > F.col("old.version")))


def day_changes(changes: DataFrame, days: DataFrame) -> DataFrame:
    """The days that ``order_changes`` touch: an order's old part is taken from its day, the new one added."""
    delta = (_shares(changes.select("new.*"), 1).unionByName(_shares(changes.where("old is not null").select("old.*"), -1))
             .groupBy("report_date").agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.sum("d").alias("d")))
    zero = F.lit(0)
    return delta.join(days, "report_date", "left").select(
        "report_date", (F.coalesce("total_orders", zero) + F.col("n")).alias("total_orders"),
        (F.coalesce("total_revenue", zero) + F.col("t")).cast("decimal(28,2)").alias("total_revenue"),
        (F.coalesce("total_discount", zero) + F.col("d")).cast("decimal(28,2)").alias("total_discount"))


def kept_revenue_stream(changes: DataFrame, state_dir: str, checkpoint: str, *, compact_every: int = 16):
    """Start a stream that keeps daily revenue up to date from order versions (``KEPT_ORDER`` columns).

    Two logs of changed rows under ``state_dir``: ``orders`` holds each
    order's newest version, ``days`` the sums of the days. Both are read as of
    the batch before, so a replayed batch changes nothing twice.
    ``kept_revenue`` reads the days.
    """
    def sink(df, batch_id):
        spark = df.sparkSession
        orders = StateLog(spark, os.path.join(state_dir, "orders"), ["order_id"], KEPT_ORDER, compact_every)
        days = StateLog(spark, os.path.join(state_dir, "days"), ["report_date"], KEPT_DAY, compact_every)
        changed = order_changes(df, orders.before(batch_id)).persist()    # read for the orders and for the days
        try:
            days.write(batch_id, day_changes(changed, days.before(batch_id)))
            orders.write(batch_id, changed.select("order_id", "new.*"))
        finally:
            changed.unpersist()
        spark.range(1).write.mode("overwrite").parquet(os.path.join(state_dir, "done", f"batch_id={batch_id}"))

    return (changes.select(*KEPT_ORDER.names).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def kept_revenue(spark: SparkSession, state_dir: str, *, compact_every: int = 16) -> DataFrame:
    """The kept days: (report_date, total_orders, total_revenue, total_discount) of days that have an order."""
    done = os.path.join(state_dir, "done")
    if not _path_exists(spark, done):
        return spark.createDataFrame([], KEPT_DAY)
    last = spark.read.parquet(done).agg(F.max("batch_id")).first()[0]
    days = StateLog(spark, os.path.join(state_dir, "days"), ["report_date"], KEPT_DAY, compact_every)
    return days.before(int(last) + 1).where("total_orders > 0")


# --------------------------------------------------------- foreachBatch sink

def stock_deduction_batch(transitions: DataFrame, orders: DataFrame, order_items: DataFrame,
                          product_ingredients: DataFrame, inventory: DataFrame) -> DataFrame:
    """Export ledger rows for orders entering ``preparing`` (one row per event and item).

    The order status used by the BOM is the transition itself, so every
    event that enters preparing deducts once.
    """
    t = transitions.select("event_id", "order_id")
    prep = orders.select("order_id").join(t.select("order_id").distinct(), "order_id", "left_semi") \
        .withColumn("status", F.lit("preparing"))
    need = bom_explosion(prep, order_items, product_ingredients, inventory, status="preparing")
    return (t.join(need, "order_id")
            .select("event_id", "order_id", "inventory_id", F.lit("export").alias("action_type"),
                    (-F.col("need")).alias("quantity_change")))


def stock_deduction_stream(status_stream: DataFrame, frames: dict, out_dir: str, checkpoint: str):
    """Start the streaming deduction: transitions per micro-batch -> ledger parquet.

    Each micro-batch writes to ``out_dir/batch_id=<n>`` in overwrite mode, so
    a replayed batch after a failure rewrites the same rows (idempotent).
    Transitions need the previous status of each order across batches; the
    stateful step keeps it per order.
    """
    return _deducting(entering_status(status_stream, "preparing"), frames, out_dir, checkpoint)


def _deducting(trans: DataFrame, frames: dict, out_dir: str, checkpoint: str):
    def sink(df, batch_id):
        # The micro-batch is read twice below: materialise it once.
        df = df.persist()
        try:
            rows = stock_deduction_batch(df, frames["orders"], frames["order_items"],
                                         frames["product_ingredients"], frames["inventory"])
            rows.write.mode("overwrite").parquet(os.path.join(out_dir, f"batch_id={batch_id}"))
        finally:
            df.unpersist()

    return (trans.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


TRANS_SCHEMA = T.StructType([T.StructField("order_id", T.LongType()), T.StructField("event_id", T.LongType()),
                             T.StructField("ts", T.TimestampType())])


def entering_status(status_events: DataFrame, target: str) -> DataFrame:
    """Stateful transitions into ``target``: state = last status per order."""
    def step(key, pdfs, state):
        rows = pd.concat(list(pdfs), ignore_index=True).sort_values(["ts", "event_id"])
        status = rows["status"].to_numpy(dtype=object)
        prev = pd.Series(status).shift(1).to_numpy(dtype=object)
        prev[0] = state.get[0] if state.exists else None
        hit = (status == target) & pd.notna(prev) & (prev != target)
        state.update((status[-1],))
        yield rows.loc[hit, ["order_id", "event_id", "ts"]]

    return status_events.groupBy("order_id").applyInPandasWithState(
        step, TRANS_SCHEMA, "status string", "append", GroupStateTimeout.NoTimeout)


ONCE_STATE = "status string, last long, deducted boolean"


def entering_once(status_events: DataFrame, target: str, *, watermark: str = "1 hour", ttl_ms: int = 7 * 86_400_000
                  ) -> DataFrame:
    """Stateful first entry into ``target`` per order, with state that expires.

    Events delivered again are dropped by id (``dropDuplicatesWithinWatermark``), and so are events later than the
    watermark. An order is deducted once: later entries of the same order do
    not count. After ``ttl_ms`` without an event an order is done with: its
    state is removed by an event-time timer, and an event after such a pause
    begins anew (that rule holds whether or not the timer has come by, so the
    result does not depend on how events are cut into micro-batches).
    """
    ttl_us = ttl_ms * 1000
    once = status_events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])

    def step(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(pdfs), ignore_index=True).sort_values(["ts", "event_id"])
        prev, last, deducted = state.get if state.exists else (None, None, False)
        us = rows["ts"].astype("datetime64[us, UTC]" if rows["ts"].dt.tz is not None else "datetime64[us]").astype("int64")
        hits = []
        for at, (t, status) in enumerate(zip(us.to_numpy().tolist(), rows["status"], strict=True)):
            if last is not None and t - last > ttl_us:
                prev, deducted = None, False
            if status == target and prev is not None and prev != target and not deducted:
                hits.append(at)
                deducted = True
            prev, last = status, t
        ends = last // 1000 + ttl_ms + 1
        if ends > state.getCurrentWatermarkMs():
            state.update((prev, last, deducted))
            state.setTimeoutTimestamp(ends)
        else:
            state.remove()
        yield rows.iloc[hits][["order_id", "event_id", "ts"]]

    return once.groupBy("order_id").applyInPandasWithState(
        step, TRANS_SCHEMA, ONCE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def first_entries(status_events: DataFrame, target: str, *, ttl_ms: int = 7 * 86_400_000) -> DataFrame:
    """Batch twin of ``entering_once``: the first entry into ``target`` per order and spell of events no more than
    ``ttl_ms`` apart."""
    from ..functions.windows import RANGES, prefix_sums, previous_values
    e = status_events.dropDuplicates(["event_id"])
    e = previous_values(e, ["order_id"], ["ts", "event_id"], RANGES, ["status", "ts"])
    paused = F.col("prev_ts").isNotNull() & (ntz_micros(F.col("ts").cast("timestamp_ntz"))
                                             - ntz_micros(F.col("prev_ts").cast("timestamp_ntz")) > ttl_ms * 1000)
    e = e.withColumn("_new", paused.cast("int"))
    e = prefix_sums(e, ["order_id"], ["ts", "event_id"], RANGES, {"_spell": F.col("_new")})
    hit = (F.col("status") == target) & F.col("prev_status").isNotNull() & (F.col("prev_status") != target) & (F.col("_new") == 0)
    first = e.where(hit).groupBy("order_id", "_spell").agg(F.min(F.struct("ts", "event_id")).alias("f"))
    return first.select("order_id", "f.event_id", "f.ts")


def stock_deduction_once_stream(status_stream: DataFrame, frames: dict, out_dir: str, checkpoint: str, *,
                                watermark: str = "1 hour", ttl_ms: int = 7 * 86_400_000):
    """``stock_deduction_stream`` that deducts an (order, item) once and forgets orders that are done with."""
    return _deducting(entering_once(status_stream, "preparing", watermark=watermark, ttl_ms=ttl_ms), frames, out_dir,
                      checkpoint)


def stock_deduction_once_twin(status_events: DataFrame, frames: dict, *, ttl_ms: int = 7 * 86_400_000) -> DataFrame:
    return stock_deduction_batch(first_entries(status_events, "preparing", ttl_ms=ttl_ms), frames["orders"],
                                 frames["order_items"], frames["product_ingredients"], frames["inventory"])


def stock_deduction_twin(status_events: DataFrame, frames: dict) -> DataFrame:
    return stock_deduction_batch(status_transitions(status_events, "preparing"), frames["orders"],
                                 frames["order_items"], frames["product_ingredients"], frames["inventory"])


def read_written(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table a stream wrote to ``path``; empty only if it wrote nothing at all."""
    if not _path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())


@dataclass
class Report:
    """What a run's progress says, over all its micro-batches."""

    input_rows: int = 0
    late_rows: int = 0
    state_rows: list[int] = field(default_factory=list)     # rows in state after each batch, all operators


def reported(query) -> Report:
    """Wait for a query that ends by itself and sum up its progress.

    Progress is read while the query runs, so batches beyond the engine's list of recent ones count, too. Late
    rows are rows that a stateful operator dropped for the watermark; an aggregate counts them after its partial
    aggregation, ``dropDuplicatesWithinWatermark`` as they come in.
    """
    seen: dict[int, dict] = {}
    running = True
    while running:
        running = not query.awaitTermination(1)
        seen.update({p["batchId"]: p for p in query.recentProgress})
    out = Report()
    for _, p in sorted(seen.items()):
        ops = p["stateOperators"]
        out.input_rows += p["numInputRows"]
        out.late_rows += sum(o["numRowsDroppedByWatermark"] for o in ops)
        out.state_rows.append(sum(o["numRowsTotal"] for o in ops))
    return out


def on_time(events: DataFrame, watermark: str) -> DataFrame:
    """Events that are new and not later than the watermark; the run's report counts the late ones exactly."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])


def run_to_memory(df: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """Drive a streaming frame to completion into a memory table (tests, smoke runs)."""
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def run_to_table(df: DataFrame, name: str, keys: list[str] | None = None) -> DataFrame:
    """Run a streaming frame to completion (availableNow) into parquet and read it back.

    Output and checkpoint live under the session's checkpoint folder (a
    shared, durable location on a cluster). Without ``keys`` the file sink
    appends. With ``keys`` the stream runs in update mode: a micro-batch
    writes only its changed rows, to ``batch_id=<n>`` in overwrite mode (a
    replayed batch rewrites the same rows and never touches older ones), and
    the reader keeps the newest row of each key.
    """
    import uuid

    from ..session import checkpoint_dir
    spark = df.sparkSession
    base = os.path.join(checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:12]}")
    out, ck = os.path.join(base, "out"), os.path.join(base, "checkpoint")
    if not keys:
        q = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
        return read_written(spark, out, df.schema)

    def sink(batch, batch_id):
        batch.write.mode("overwrite").parquet(os.path.join(out, f"batch_id={batch_id}"))

    q = (df.writeStream.foreachBatch(sink).option("checkpointLocation", ck)
         .outputMode("update").trigger(availableNow=True).start())
    q.awaitTermination()
    if not _path_exists(spark, out):
        return spark.createDataFrame([], df.schema)
    changes = spark.read.schema(T.StructType([*df.schema.fields]).add("batch_id", T.LongType())).parquet(out)
    rest = [c for c in df.columns if c not in keys]
    newest = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_v"))
    return newest.select(*[F.col(f"_v.{c}").alias(c) if c in rest else F.col(c) for c in df.columns])
