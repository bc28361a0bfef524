"""Prefix scans and the limiter over sampled ranges: a hot key at one instant is many tasks, with equal results."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from fold import rate_limit_fold
from pyspark.sql import functions as F
from support import rows

from mealops.functions import windows as W
from mealops.operators import stock
from mealops.streaming import streams as S

T0 = dt.datetime(2024, 1, 1)
LOGS = "inventory_id long, order_id long, line_no int, action_type string, quantity_change decimal(10,2), created_at timestamp_ntz"
COLS = ("inventory_id", "order_id", "line_no", "before", "after")


@pytest.fixture
def many_ranges(spark):
    """Small tables keep all their ranges, as large ones would."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


def ledger(spark, n=900):
    """Item 0 holds most rows, all items at one instant; rows repeat."""
    rng = random.Random(3)
    out = []
    for i in range(n):
        change = Decimal(rng.randint(1, 40)) * (1 if rng.random() < .45 else -1)
        out.append((0 if i % 4 else i % 9, i // 2, i % 2, "import" if change > 0 else "export", change, T0))
    out += out[:20] + [(None, 1, 1, "import", Decimal(5), T0), (None, 2, 1, "export", Decimal(-2), T0)]
    return spark.createDataFrame(out, LOGS).repartition(5)


def test_hot_instant_is_many_ranges(spark, many_ranges):
    r = W.ranged(ledger(spark), ["inventory_id"], ["created_at", "order_id", "line_no"])
    per_range = r.where("inventory_id = 0").groupBy(W.RANGES).count().collect()
    assert len(per_range) >= 4 and max(x["count"] for x in per_range) < 300
    one = spark.createDataFrame([(1, T0)] * 400, "inventory_id long, created_at timestamp_ntz")     # copies, too
    assert W.ranged(one, ["inventory_id"], ["created_at"]).select(W.RANGES).distinct().count() >= 4


ORDER = ["created_at", "order_id", "line_no", "action_type", "quantity_change"]


def test_scans_equal_single_level(spark, many_ranges):
    df = ledger(spark)
    got, exp = (rows(W.prefix_sums(df, ["inventory_id"], ORDER, b, {"run": F.col("quantity_change")}, seq="seq")
                     .na.fill(-1, ["inventory_id"]), "inventory_id", "order_id", "line_no", "seq", "run")
                for b in (W.RANGES, None))
    assert got == exp
    got, exp = (rows(W.prefix_sums_and_lows(df, ["inventory_id"], ORDER, b, F.col("quantity_change"), "run", "low")
                     .na.fill(-1, ["inventory_id"]).withColumn("low", F.coalesce("low", F.lit(10 ** 6))),
                     "inventory_id", "order_id", "line_no", "run", "low") for b in (W.RANGES, None))
    assert got == exp
    some = df.withColumn("import_of", F.when(F.col("action_type") == "import", F.col("order_id")))
    got, exp = (rows(W.last_non_null(some, ["inventory_id"], ORDER, b, "import_of", "last")
                     .na.fill(-1, ["inventory_id", "last"]), "inventory_id", "order_id", "line_no", "last")
                for b in (W.RANGES, None))
    assert got == exp
    got, exp = (rows(W.previous_values(df, ["inventory_id"], ORDER, b, ["order_id"]).na.fill(-1, ["inventory_id", "prev_order_id"]),
                     "inventory_id", "order_id", "line_no", "prev_order_id") for b in (W.RANGES, None))
    assert got == exp


def folded(df, opening, floor):
    qty, low, out = {k: q for k, q, _ in opening}, {k: m for k, _, m in opening}, []
    for r in sorted(df.where("inventory_id is not null").collect(), key=lambda r: tuple(r[c] for c in ORDER)):
        k, before = r.inventory_id, qty[r.inventory_id]
        qty[k] = max(floor, before + r.quantity_change)
        if before > low[k] >= qty[k]:
            out.append((k, r.order_id, r.line_no, before, qty[k]))
    return sorted(out)


def test_crossings_at_one_instant(spark, many_ranges):
    df = ledger(spark)
    opening = [(k, Decimal(k * 7), Decimal(10)) for k in range(9)]
    inv = spark.createDataFrame(opening, "inventory_id long, quantity decimal(10,2), min_quantity decimal(10,2)")
    assert rows(stock.low_stock_crossings(df, inv), *COLS) == folded(df, opening, Decimal(-10 ** 6))
    got = rows(stock.low_stock_crossings_floored(df, inv), *COLS)
    assert got == folded(df, opening, Decimal(0)) and got


def test_fifo_at_one_instant(spark, many_ranges):
    df = ledger(spark).where("inventory_id is not null").dropDuplicates(["inventory_id", "order_id", "line_no"])
    got = rows(stock.fifo_ledger(df), "inventory_id", "need_order", "need_line", "batch_order", "batch_line", "qty")
    exp = []
    for k in range(9):
        own = sorted(df.where(F.col("inventory_id") == k).collect(), key=lambda r: (r.created_at, r.order_id, r.line_no))
        supply = [[r.order_id, r.line_no, r.quantity_change] for r in own if r.action_type == "import"]
        for r in own:
            need = -r.quantity_change if r.action_type == "export" else 0
            while need > 0 and supply:
                take = min(need, supply[0][2])
                exp.append((k, r.order_id, r.line_no, supply[0][0], supply[0][1], take))
                need -= take
                supply[0][2] -= take
                if not supply[0][2]:
                    supply.pop(0)
    assert got == sorted(exp) and len(got) > 100


@pytest.mark.parametrize("seconds,window_ms,limit", [(7, 60_000, 4), (7, 3_600_000, 100), (0, 60_000, 3), (900, 60_000, 1),
                                                    (11, 1, 1), (5, 10_000_000, 900)])
def test_limiter_over_ranges(spark, many_ranges, seconds, window_ms, limit):
    """One key with most requests, over many ranges; keys that begin or end in the middle of a range; null keys."""
    rng = random.Random(seconds)
    data = [(i, None if i % 11 == 0 else 0 if i % 5 else i % 4, T0 + dt.timedelta(seconds=rng.randint(0, 400 * seconds)))
            for i in range(1500)]
    df = spark.createDataFrame(data, "event_id long, user_id long, ts timestamp_ntz").repartition(4)
    cols = ("key", "event_id", "count", "remaining", "blocked")
    par, seq = (f(df, window_ms=window_ms, limit=limit).na.fill("none", ["key"]) for f in
                (S.rate_limit_violations, rate_limit_fold))
    assert rows(par, *cols) == rows(seq, *cols)


def test_limiter_of_nothing(spark):
    nothing = spark.createDataFrame([], "event_id long, user_id long, ts timestamp_ntz")
    assert S.rate_limit_violations(nothing).count() == 0
