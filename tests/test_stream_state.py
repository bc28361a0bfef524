"""Streams with expiring and updated state: replays, state size, changed rows, late rows."""

import datetime as dt
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F
from support import rows

from mealops.streaming import streams as S
from mealops.streaming.statelog import StateLog

T0 = dt.datetime(2024, 1, 1)
EVENTS = "event_id long, order_id long, status string, ts timestamp"
HOUR = 3_600_000


def _feed(spark, folder, batches, schema):
    """One file per batch, each with a later modification time."""
    for i, data in enumerate(batches):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(folder)
        for f in os.listdir(folder):
            path = os.path.join(folder, f)
            if f.endswith(".parquet") and os.path.getmtime(path) > 2_000_000:
                os.utime(path, (1_000_000 + i, 1_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _entries(events, ttl_ms):
    """(order, event) deducted, by a plain fold over all events in order."""
    state, out = {}, []
    for ts, event_id, order, status in sorted({(e[3], e[0], e[1], e[2]) for e in events}):
        prev, last, done = state.get(order, (None, None, False))
        if last is not None and ts - last > dt.timedelta(milliseconds=ttl_ms):
            prev, done = None, False
        if status == "preparing" and prev not in (None, "preparing") and not done:
            out.append((order, event_id))
            done = True
        state[order] = (status, ts, done)
    return sorted(out)


def _orders_of_days(days, per_day):
    """Every day has orders of its own; events of a day's orders lie within it."""
    rng, out, n = random.Random(1), [], 0
    for d in range(days):
        batch = []
        for o in range(per_day):
            t = T0 + dt.timedelta(days=d, minutes=rng.randint(0, 600))
            for status in ("pending", "confirmed", "preparing", "ready", "preparing", "ready"):
                batch.append((n, d * per_day + o, status, t))
                t += dt.timedelta(minutes=rng.randint(1, 20))
                n += 1
        out.append(batch)
    return out


def test_replayed_events_deduct_once_and_state_stays_flat(spark):
    days = _orders_of_days(12, 20)
    batches = [b + prev[-30:] + b[:25] for prev, b in zip([[], *days], days)]      # replays of now and of before
    stream = _feed(spark, tempfile.mkdtemp(prefix="mealops-once-"), batches, EVENTS)
    once = S.entering_once(stream, "preparing", watermark="26 hours", ttl_ms=12 * HOUR)
    q = (once.writeStream.format("memory").queryName("once").outputMode("append")
         .option("checkpointLocation", tempfile.mkdtemp()).trigger(availableNow=True).start())
    report = S.reported(q)
    got = rows(spark.table("once"), "order_id", "event_id")
    assert got == _entries([e for b in days for e in b], 12 * HOUR) and len(got) == 12 * 20
    assert report.late_rows == 0 and report.input_rows == sum(map(len, batches))
    # Events and orders of the days that the watermark keeps open (seven rows an order), however long the run.
    assert max(report.state_rows) <= 4 * 20 * 7 < 12 * 20 * 7 and len(report.state_rows) >= 12


@pytest.mark.parametrize("ttl_ms", [HOUR, 1000 * HOUR])
def test_first_entries_twin(spark, ttl_ms):
    rng = random.Random(2)
    data = [(i, rng.randint(0, 6), rng.choice(("pending", "preparing", "ready")), T0 + dt.timedelta(minutes=rng.randint(0, 6000)))
            for i in range(400)]
    df = spark.createDataFrame(data + data[:50], EVENTS)
    assert rows(S.first_entries(df, "preparing", ttl_ms=ttl_ms), "order_id", "event_id") == _entries(data, ttl_ms)
    stream = _feed(spark, tempfile.mkdtemp(prefix="mealops-twin-"), [data + data[:50]], EVENTS)
    S.run_to_memory(S.entering_once(stream, "preparing", ttl_ms=ttl_ms), f"twin_{ttl_ms}", tempfile.mkdtemp())
    assert rows(spark.table(f"twin_{ttl_ms}"), "order_id", "event_id") == _entries(data, ttl_ms)


def test_late_rows_are_absent_and_counted(spark):
    day = [(i, 1, "pending", T0 + dt.timedelta(hours=i)) for i in range(50)]
    late = [(100, 1, "pending", T0 + dt.timedelta(hours=1)), (101, 1, "pending", T0), (102, 1, "pending", T0 + dt.timedelta(hours=48))]
    stream = _feed(spark, tempfile.mkdtemp(prefix="mealops-late-"), [day, [(50, 1, "ready", T0 + dt.timedelta(hours=49))], late],
                   EVENTS)                                   # the engine drops by the watermark of the batch before
    q = (S.on_time(stream, "2 hours").writeStream.format("memory").queryName("on_time").outputMode("append")
         .option("checkpointLocation", tempfile.mkdtemp()).trigger(availableNow=True).start())
    report = S.reported(q)
    assert rows(spark.table("on_time"), "event_id") == [(i,) for i in [*range(51), 102]]
    assert report.late_rows == 2 and report.input_rows == 54


def _size(folder):
    return len(os.listdir(folder)) if os.path.isdir(folder) else -1


def test_state_log(spark):
    path = tempfile.mkdtemp(prefix="mealops-log-")
    schema = spark.createDataFrame([], "k long, v long").schema
    log = StateLog(spark, path, ["k"], schema, compact_every=3)
    exp, rng = {}, random.Random(4)
    for n in range(11):
        assert rows(log.before(n)) == sorted(exp.items())
        changed = {rng.randint(0, 9): 100 * n + i for i in range(3)}
        for _ in range(2):                                           # a replay overwrites
            log.write(n, spark.createDataFrame(list(changed.items()), schema))
        assert spark.read.parquet(f"{path}/batch_id={n}").count() == len(changed)
        exp.update(changed)
    assert rows(log.before(11)) == sorted(exp.items())
    assert rows(log.before(9)) and rows(StateLog(spark, path, ["k"], schema, 3).before(11)) == sorted(exp.items())
    kept = sorted(f for f in os.listdir(path))
    assert kept == sorted([f"batch_id={n}" for n in range(6, 11)] + ["snapshot_id=5", "snapshot_id=8"])
    with pytest.raises(Exception, match="snapshot_id=2"):
        log.before(3).count()                                        # gone: no silent hole
    with pytest.raises(ValueError):
        StateLog(spark, path, ["k"], schema, 1)


def test_low_stock_state_is_changed_rows_only(spark, bound):
    from decimal import Decimal
    logs = "inventory_id long, order_id long, line_no int, action_type string, quantity_change decimal(10,2), created_at timestamp_ntz"
    inv = spark.createDataFrame([(k, f"i{k}", Decimal(20), Decimal(10)) for k in range(100)],
                                "inventory_id long, name string, quantity decimal(10,2), min_quantity decimal(10,2)")
    batches, n = [], 0
    for b in range(5):
        batches.append([(k, 10 * b + k, 1, "export" if (b + k) % 3 else "import", Decimal(-7 if (b + k) % 3 else 9),
                         T0 + dt.timedelta(hours=b)) for k in range(b, b + 4)])
    base = tempfile.mkdtemp(prefix="mealops-changed-")
    q = S.low_stock_alert_stream(_feed(spark, f"{base}/in", batches, logs), inv, f"{base}/alerts", f"{base}/state",
                                 f"{base}/ck", compact_every=2)
    q.awaitTermination()
    assert [spark.read.parquet(f"{base}/state/batch_id={n}").count() for n in (2, 3, 4)] == [4, 4, 4]
    assert _size(f"{base}/state/batch_id=0") == -1 and _size(f"{base}/state/snapshot_id=3") > 0
    left = dict(rows(StateLog(spark, f"{base}/state", ["inventory_id"],
                              spark.read.parquet(f"{base}/state/batch_id=4").schema, 2).before(5)))
    exp = {}
    for b in batches:
        for r in b:
            exp[r[0]] = exp.get(r[0], Decimal(20)) + r[4]
    assert left == exp
    from mealops.operators import stock
    cols = ("inventory_id", "order_id", "line_no", "before", "after")
    got = rows(spark.read.parquet(f"{base}/alerts"), *cols)
    whole = stock.low_stock_crossings(spark.createDataFrame([r for b in batches for r in b], logs), inv)
    assert got == rows(whole.select(*cols[:3], F.col("before").cast("double").alias("before"),
                                    F.col("after").cast("double").alias("after")), *cols) and got
