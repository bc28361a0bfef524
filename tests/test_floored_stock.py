"""Low-stock crossings with stock floored at 0, against a plain fold."""

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from support import rows
from mealops.functions.windows import prefix_sums_and_lows
from mealops.operators import stock
from mealops.streaming import streams as S

COLS = ("inventory_id", "order_id", "line_no", "before", "after")
LOGS = "inventory_id long, order_id long, line_no int, action_type string, quantity_change decimal(10,2), created_at timestamp_ntz"
INVENTORY = "inventory_id long, name string, quantity decimal(10,2), min_quantity decimal(10,2)"


def _data(n=400):
    rng, t0 = random.Random(7), dt.datetime(2024, 1, 1)
    logs = []
    for i in range(n):
        change = Decimal(rng.randint(1, 40)) if rng.random() < 0.4 else -Decimal(rng.randint(1, 40))
        logs.append((0 if i % 3 else i % 7, i, 1, "import" if change > 0 else "export", change,
                     t0 + dt.timedelta(minutes=11 * i)))
    opening = [(k, f"item {k}", Decimal(k * 6 - 4), Decimal(10)) for k in range(7)]
    return logs, opening


def _fold(logs, opening):
    qty, low = {k: q for k, _, q, _ in opening}, {k: m for k, _, _, m in opening}
    out = []
    for k, o, line, _, change, _ in sorted(logs, key=lambda r: (r[5], r[1], r[2])):
        before = qty[k]
        qty[k] = max(Decimal(0), before + change)
        if before > low[k] >= qty[k]:
            out.append((k, o, line, before, qty[k]))
    return sorted(out), qty


def test_alert_after_a_long_fall_is_kept(spark):
    t0 = dt.datetime(2024, 1, 1)
    changes = [-15, -100, -100, 30, -25]
    logs = spark.createDataFrame([(1, i, 1, "import" if c > 0 else "export", Decimal(c), t0 + dt.timedelta(hours=2 * i))
                                  for i, c in enumerate(changes)], LOGS)
    inv = spark.createDataFrame([(1, "rice", Decimal(20), Decimal(10))], INVENTORY)
    assert rows(stock.low_stock_crossings_floored(logs, inv), *COLS) == [(1, 0, 1, 20, 5), (1, 4, 1, 30, 5)]
    notices = stock.low_stock_notifications(stock.low_stock_crossings_floored(logs, inv), inv)
    assert notices.count() == 2


def test_floored_crossings_equal_a_plain_fold(spark):
    logs, opening = _data()
    exp, _ = _fold(logs, opening)
    df, inv = spark.createDataFrame(logs, LOGS), spark.createDataFrame(opening, INVENTORY)
    got = rows(stock.low_stock_crossings_floored(df, inv), *COLS)
    assert got == exp and len(got) > len(rows(stock.low_stock_crossings(df, inv), *COLS))


def test_lows_two_level_equal_single_level(spark):
    logs, _ = _data(200)
    df = spark.createDataFrame(logs, LOGS)
    a, b = (rows(prefix_sums_and_lows(df, ["inventory_id"], ["created_at", "order_id"], bucket, F.col("quantity_change"),
                                      "run", "low").withColumn("low", F.coalesce("low", F.lit(10 ** 6))),
                 "inventory_id", "order_id", "run", "low") for bucket in (F.date_trunc("hour", "created_at"), None))
    assert a == b


def test_floored_state_over_batches(spark):
    logs, opening = _data()
    exp, left = _fold(logs, opening)
    inv = spark.createDataFrame(opening, INVENTORY)
    state = inv.select("inventory_id", F.col("quantity").cast("decimal(18,2)").alias("qty"))
    got = []
    for at in range(0, len(logs), 90):
        alerts, new = S.low_stock_floored_batch(spark.createDataFrame(logs[at:at + 90], LOGS), state, inv)
        got += rows(alerts, *COLS)
        state = spark.createDataFrame(new.collect(), new.schema)
    assert sorted(got) == exp
    assert {r["inventory_id"]: r["qty"] for r in state.collect()} == left


def test_running_sums_are_made_once_a_batch(spark):
    logs, opening = _data(200)
    exp, left = _fold(logs, opening)
    inv = spark.createDataFrame(opening, INVENTORY)
    state = inv.select("inventory_id", F.col("quantity").cast("decimal(18,2)").alias("qty"))
    kept = []

    def keep(frame):
        kept.append(frame.persist())
        return kept[-1]

    alerts, new = S.low_stock_floored_batch(spark.createDataFrame(logs, LOGS), state, inv, keep)
    for df in (alerts, new):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "InMemoryRelation" in plan
    assert rows(alerts, *COLS) == exp and {r["inventory_id"]: r["qty"] for r in new.collect()} == left
    for frame in kept:
        frame.unpersist()
