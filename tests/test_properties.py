"""Properties and edge cases: helpers, folds, sinks, checks."""

import datetime as dt
import os
import tempfile
from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from support import rows
from mealops.functions.windows import global_position, last_non_null, prefix_sums, previous_values
from mealops.operators import customers, quality, reports, stock
from mealops.sources import sinks


def _ledger(spark, n_keys=3, per_key=40):
    t0 = dt.datetime(2024, 1, 1)
    data = [(k if i % 3 else 0, i, t0 + dt.timedelta(hours=7 * i + k), (i * 7 + k) % 11 - 4)
            for k in range(n_keys) for i in range(per_key)]
    return spark.createDataFrame(data, "k long, i long, ts timestamp_ntz, v long")


def test_two_level_windows_equal_single_level(spark):
    df = _ledger(spark)
    order = ["ts", "i", "v"]
    a = prefix_sums(df, ["k"], order, F.to_date("ts"), {"run": F.col("v")}, seq="seq")
    b = prefix_sums(df, ["k"], order, None, {"run": F.col("v")}, seq="seq")
    assert rows(a, "k", "i", "ts", "run", "seq") == rows(b, "k", "i", "ts", "run", "seq")
    c = previous_values(df, ["k"], order, F.to_date("ts"), ["v", "i"])
    d = previous_values(df, ["k"], order, None, ["v", "i"])
    assert rows(c, "k", "i", "ts", "prev_v", "prev_i") == rows(d, "k", "i", "ts", "prev_v", "prev_i")
    sparse = df.withColumn("x", F.when(F.col("i") % 9 == 0, F.col("v")))
    e = last_non_null(sparse, ["k"], order, F.to_date("ts"), "x", "ff")
    f = last_non_null(sparse, ["k"], order, None, "x", "ff")
    assert rows(e, "k", "i", "ts", "ff") == rows(f, "k", "i", "ts", "ff")


def test_global_position_is_dense(spark):
    df = spark.range(0, 500).select((F.col("id") * 7919 % 500).alias("x"), F.col("id"))
    out = global_position(df, [F.col("x").desc(), F.col("id")], "pos")
    got = [r["x"] for r in out.orderBy("pos").collect()]
    assert got == sorted(got, reverse=True)
    assert sorted(r["pos"] for r in out.collect()) == list(range(1, 501))


def test_running_balance_ends_at_total(bound):
    bal = stock.stock_running_balance(bound.inventory_logs)
    last = bal.groupBy("inventory_id").agg(F.max_by("balance", "seq").alias("b"))
    tot = bound.inventory_logs.groupBy("inventory_id").agg(F.sum("quantity_change").alias("b"))
    assert rows(last) == rows(tot)


def test_fifo_allocates_min_of_supply_and_demand(bound):
    logs = bound.inventory_logs
    b, n = stock.ledger_batches(logs), stock.ledger_needs(logs)
    alloc = stock.fifo_allocation(b, n, width=50)
    got = alloc.groupBy("inventory_id").agg(F.sum("qty").alias("a"))
    sup = b.groupBy("inventory_id").agg(F.sum("qty").alias("s"))
    dem = n.groupBy("inventory_id").agg(F.sum("qty").alias("d"))
    exp = sup.join(dem, "inventory_id").select("inventory_id", F.least("s", "d").alias("a")).filter("a > 0")
    assert rows(got) == rows(exp)


def test_share_of_total_sums_to_one(bound):
    s = reports.share_of_total(bound.orders, "payment_method", "total")
    assert abs(sum(r["share"] for r in s.collect()) - 1.0) < 1e-9


def test_cart_fold_rules(spark):
    t0 = dt.datetime(2024, 1, 1)
    ev = [(1, 1, 5, "add", 2, "no onion"), (2, 1, 5, "add", 1, "extra"),        # 3, first notes kept
          (3, 1, 6, "set", 4, None),                                           # set on missing line: no-op
          (4, 1, 6, "add", 1, "a"), (5, 1, 6, "set", 4, None), (6, 1, 6, "add", 2, None),  # 4 + 2
          (7, 1, 7, "add", 1, "x"), (8, 1, 7, "set", 0, None),                 # removed
          (9, 2, 5, "add", 1, "y"), (10, 2, None, "clear", None, None), (11, 2, 8, "add", 3, "z")]
    df = spark.createDataFrame([(i, u, p, a, q, n, t0 + dt.timedelta(minutes=i)) for i, u, p, a, q, n in ev],
                               "event_id long, user_id long, product_id long, action string, qty int, notes string, ts timestamp_ntz")
    out = rows(customers.cart_fold(df), "user_id", "product_id", "qty", "notes")
    assert out == [(1, 5, 3, "no onion"), (1, 6, 6, "a"), (2, 8, 3, "z")]


def test_export_csv_format_and_empty(spark):
    df = spark.createDataFrame([(1, 'say "hi"', None)], "a int, b string, c string")
    d = tempfile.mkdtemp(prefix="mealops-csv-")
    out = os.path.join(d, "x")
    assert sinks.export_csv(df, out, single_file=True)
    parts = [p for p in os.listdir(out) if p.startswith("part-")]
    text = open(os.path.join(out, parts[0]), encoding="utf-8").read()
    assert text.splitlines() == ["﻿a,b,c", '"1","say ""hi""",""']
    assert not sinks.export_csv(df.filter("a < 0"), os.path.join(d, "empty"))
    assert not os.path.exists(os.path.join(d, "empty"))


def test_merge_dimension_rules(spark):
    cur = spark.createDataFrame([(1, "A", Decimal("10.00"), 100)], "product_id long, name string, price decimal(18,2), calories int")
    feed = spark.createDataFrame([(1, "A2", None, None, 1), (1, "A3", Decimal("12.00"), None, 2),
                                  (2, "B", Decimal("5.00"), None, 1), (3, None, Decimal("1.00"), 9, 1)],
                                 "product_id long, name string, price decimal(18,2), calories int, seq int")
    merged, rejects = sinks.merge_dimension(cur, feed, key="product_id", required=["name"], order=["seq"],
                                            defaults={"calories": 0})
    assert rows(merged) == [(1, "A3", Decimal("12.00"), 100), (2, "B", Decimal("5.00"), 0)]
    assert [r["reason"] for r in rejects.collect()] == ["missing name"]


def test_validate_constraints_finds_violations(spark):
    frames = {
        "orders": spark.createDataFrame([(1, "FF-1", "pending", "online", 5), (2, "FF-1", "weird", "online", 99)],
                                        "order_id long, order_code string, status string, order_type string, user_id long"),
        "users": spark.createDataFrame([(5, "u", "customer")], "user_id long, full_name string, role string"),
    }
    keys = {"orders": ["order_id"], "users": ["user_id"]}
    out = rows(quality.validate_constraints(frames, keys), "table_name", "rule", "key")
    assert ("orders", "check_status", "2") in out
    assert ("orders", "unique_order_code", "FF-1") in out
    assert ("orders", "fk_user_id_users", "2") in out
    assert len(out) == 3


def test_load_tables_round_trip(spark, bound):
    d = tempfile.mkdtemp(prefix="mealops-load-")
    bound.vouchers.write.parquet(os.path.join(d, "vouchers.parquet"))
    t = sinks.load_tables(spark, d, ["vouchers"])
    assert list(t) == ["vouchers"]
    assert t["vouchers"].count() == bound.vouchers.count()
    assert "starts_at" in t["vouchers"].columns   # schema columns absent from the file read as NULL


def test_notification_feed_cuts_roles_first(bound):
    from mealops.operators.delivery import notification_feed
    out = notification_feed(bound.notifications, bound.users, k=5)
    per_user = out.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("m"))
    assert all(r["n"] <= 5 and r["n"] == r["m"] for r in per_user.collect())
    w = Window.partitionBy("user_id")
    unread = out.withColumn("u2", F.count_if(~F.col("is_read")).over(w))
    assert all(r["unread"] == r["u2"] for r in unread.collect())


def test_hot_key_is_split_by_bucket(spark):
    """A key holding most rows is windowed per (key, bucket), not per key."""
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(0 if i % 10 else i, i, t0 + dt.timedelta(minutes=17 * i), 1) for i in range(600)],
                               "k long, i long, ts timestamp_ntz, v long")
    from mealops.functions.windows import time_bucket
    out = prefix_sums(df, ["k"], ["ts", "i"], time_bucket("ts"), {"run": F.col("v")}, seq="seq")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "__bucket" in plan and "hashpartitioning(__group#" in plan
    hot = sorted(r["run"] for r in out.filter("k = 0").collect())
    assert hot == list(range(1, len(hot) + 1))


def test_export_csv_every_part_opens_with_header(spark):
    df = spark.range(0, 40, numPartitions=4).select(F.col("id").alias("n"), (F.col("id") * 2).alias("m"))
    out = os.path.join(tempfile.mkdtemp(prefix="mealops-csv-parts-"), "x")
    assert sinks.export_csv(df, out)
    parts = sorted(p for p in os.listdir(out) if p.startswith("part-"))
    texts = [open(os.path.join(out, p), encoding="utf-8").read().splitlines() for p in parts]
    texts = [t for t in texts if t]
    assert len(texts) == 4 and all(t[0] == "﻿n,m" for t in texts)
    body = sorted(line for t in texts for line in t[1:])
    assert body == sorted(f'"{i}","{2 * i}"' for i in range(40))
