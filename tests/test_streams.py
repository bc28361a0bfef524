"""Streams: the streaming run equals its batch twin."""

import os
import tempfile

from pyspark.sql import functions as F

from support import SMALL, rows
from fold import rate_limit_fold
from mealops.operators.orders import status_transitions
from mealops.streaming import streams as S


def _ck():
    return tempfile.mkdtemp(prefix="mealops-stream-")


def test_rate_limit_stream_equals_batch(spark, bound):
    ev = S.read_events_stream(spark, SMALL)
    S.run_to_memory(S.rate_limit_stream(ev, window_ms=86_400_000, limit=2), "rl_stream", _ck())
    got = rows(spark.table("rl_stream"), "key", "event_id", "count", "remaining", "blocked")
    exp = rows(S.rate_limit_violations(bound.raw("events"), window_ms=86_400_000, limit=2),
               "key", "event_id", "count", "remaining", "blocked")
    assert got == exp and any(r[4] for r in got)


def test_transitions_stream_equals_batch(spark, bound):
    st = S.status_events_of(S.read_events_stream(spark, SMALL))
    S.run_to_memory(S.entering_status(st, "preparing"), "tr_stream", _ck())
    got = rows(spark.table("tr_stream"), "order_id", "event_id")
    exp = rows(status_transitions(bound.status_events, "preparing"), "order_id", "event_id")
    assert got == exp and got


def test_recent_events_stream_complete_mode(spark, bound):
    ev = S.read_events_stream(spark, SMALL)
    S.run_to_memory(S.recent_events(ev, watermark="10 minutes"), "recent_stream", _ck(), mode="complete")
    got = rows(spark.table("recent_stream"))
    exp = rows(S.recent_events(bound.raw("events")))
    assert got == exp


def test_order_status_stream_matches_batch(spark, bound):
    st = S.status_events_of(S.read_events_stream(spark, SMALL))
    got = S.run_to_table(S.order_status_stream(st), "status_test", keys=["order_id"])
    exp = S.order_status_stream(bound.status_events)
    cols = ["order_id", "status"]
    assert rows(got, *cols) == rows(exp, *cols)


def test_stream_sources_accept_directories(spark):
    d = tempfile.mkdtemp(prefix="mealops-dir-")
    spark.read.parquet(os.path.join(SMALL, "events.parquet")).repartition(3).write.parquet(os.path.join(d, "events.parquet"))
    ev = S.read_events_stream(spark, d, max_files=1)
    S.run_to_memory(ev.select("event_id"), "dir_stream", _ck())
    assert spark.table("dir_stream").count() == spark.read.parquet(os.path.join(SMALL, "events.parquet")).count()


def test_parallel_rate_limit_equals_sequential_fold(spark, bound):
    import datetime as dt
    cols = ("key", "event_id", "count", "remaining", "blocked")
    for window_ms, limit in [(86_400_000, 2), (3_600_000, 1), (7 * 86_400_000, 5)]:
        par = S.rate_limit_violations(bound.raw("events"), window_ms=window_ms, limit=limit)
        seq = rate_limit_fold(bound.raw("events"), window_ms=window_ms, limit=limit)
        assert rows(par, *cols) == rows(seq, *cols)
    # One hot key with most of the traffic, ties in time included.
    t0 = dt.datetime(2024, 1, 1)
    hot = spark.createDataFrame([(i, 0 if i % 5 else i % 3, t0 + dt.timedelta(seconds=(i // 2) * 7))
                                 for i in range(3000)], "event_id long, user_id long, ts timestamp_ntz")
    par = S.rate_limit_violations(hot, window_ms=60_000, limit=4)
    seq = rate_limit_fold(hot, window_ms=60_000, limit=4)
    assert rows(par, *cols) == rows(seq, *cols)


def _time_split(spark, src, ts_col, out_dir, parts=3):
    """Write ``src`` as ``parts`` files ordered by time, one write (and mtime) each."""
    import time as _t
    df = src.withColumn("_d", F.to_date(ts_col))
    days = sorted(r["_d"] for r in df.select("_d").distinct().collect())
    cuts = [days[len(days) * i // parts] for i in range(1, parts)]
    bounds = [None, *cuts, None]
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        part = df
        if lo is not None:
            part = part.filter(F.col("_d") >= F.lit(lo))
        if hi is not None:
            part = part.filter(F.col("_d") < F.lit(hi))
        part.drop("_d").coalesce(1).write.mode("append").parquet(out_dir)
        _t.sleep(1.1)   # distinct modification times: the file source reads in that order


def test_low_stock_stream_state_across_batches(spark, bound):
    from mealops.operators import stock
    d = tempfile.mkdtemp(prefix="mealops-ledger-")
    _time_split(spark, spark.read.parquet(os.path.join(SMALL, "lineitem.parquet")), "l_shipdate",
                os.path.join(d, "lineitem.parquet"))
    li = S.read_table_stream(spark, d, "lineitem", max_files=1)
    rf = F.col("l_returnflag")
    qty = F.col("l_quantity").cast("decimal(10,2)")
    ledger = li.select(F.col("l_partkey").alias("inventory_id"), F.col("l_orderkey").alias("order_id"),
                       F.col("l_linenumber").alias("line_no"),
                       F.when(rf == "R", "waste").when(rf == "A", "import").otherwise("export").alias("action_type"),
                       F.when(rf == "A", qty).otherwise(-qty).alias("quantity_change"),
                       F.col("l_shipdate").alias("created_at"))
    base = tempfile.mkdtemp(prefix="mealops-lowstock-")
    q = S.low_stock_alert_stream(ledger, bound.inventory, os.path.join(base, "alerts"),
                                 os.path.join(base, "state"), os.path.join(base, "ck"))
    q.awaitTermination()
    assert len([p for p in os.listdir(os.path.join(base, "state")) if p.startswith("batch_id=")]) == 3
    cols = ("inventory_id", "order_id", "line_no", "before", "after")
    got = rows(spark.read.parquet(os.path.join(base, "alerts")), *cols)
    exp = rows(stock.low_stock_crossings(bound.inventory_logs, bound.inventory)
               .select("inventory_id", "order_id", "line_no", F.col("before").cast("double").alias("before"),
                       F.col("after").cast("double").alias("after")), *cols)
    assert got == exp and got


def test_transition_state_across_batches(spark, bound):
    d = tempfile.mkdtemp(prefix="mealops-events-")
    _time_split(spark, spark.read.parquet(os.path.join(SMALL, "events.parquet")), "ts",
                os.path.join(d, "events.parquet"))
    st = S.status_events_of(S.read_events_stream(spark, d, max_files=1))
    S.run_to_memory(S.entering_status(st, "preparing"), "tr_multi", _ck())
    got = rows(spark.table("tr_multi"), "order_id", "event_id")
    exp = rows(status_transitions(bound.status_events, "preparing"), "order_id", "event_id")
    assert got == exp and got
