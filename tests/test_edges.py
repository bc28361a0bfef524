"""Edge cases: empty inputs, NULLs, zero denominators, malformed text."""

import datetime as dt
from decimal import Decimal

from support import ROOT, rows
from pyspark.sql import functions as F

from mealops.operators import customers, orders, pricing, reports, stock
from mealops.sources import parse


def test_clamp_limit_follows_parse_int():
    assert [orders.clamp_limit(x) for x in ["500", "0", "abc", None, "-5", "12abc", " 7 ", 20]] == \
        [200, 50, 50, 50, 1, 12, 7, 20]


def test_parse_order_items_text_rules(spark):
    req = spark.createDataFrame(
        [(1, 1, '[{"product_id":5,"qty":2,"notes":"x","price":9},{"product_id":6,"qty":1}]'),
         (2, 1, "not json"), (3, 1, "[]"), (4, 1, None)],
        "order_id long, line_no int, items_json string")
    out = rows(parse.parse_order_items(req), "order_id", "product_id", "qty", "notes")
    assert out == [(1, 5, 2, "x"), (1, 6, 1, None)]


def test_revenue_report_empty_range(bound):
    assert reports.revenue_report(bound.orders, date_from="1900-01-01", date_to="1900-12-31").count() == 0


def test_dashboard_kpi_without_orders_is_zero(bound):
    ist = stock.inventory_status(bound.inventory, bound.suppliers, as_of="2001-08-01")
    r = reports.dashboard_kpi(bound.orders, bound.subscriptions, ist, as_of="1900-01-01").collect()[0]
    assert r["revenue_today"] == 0 and r["orders_today"] == 0


def test_retention_without_previous_buyers_is_null(bound):
    r = customers.retention_rate(bound.orders, as_of="1900-01-01", days=30).collect()[0]
    assert r["previous_buyers"] == 0 and r["rate"] is None


def test_order_summary_without_items(spark):
    o = spark.createDataFrame([(1, 7, Decimal("10.00")), (2, None, Decimal("5.00"))],
                              "order_id long, user_id long, total decimal(18,2)")
    u = spark.createDataFrame([(7, "An")], "user_id long, full_name string")
    it = spark.createDataFrame([(1, 2, 300)], "order_id long, quantity int, calories_snapshot int")
    out = rows(orders.order_summary(o, u, it), "order_id", "customer_name", "item_count", "total_calories")
    assert out == [(1, "An", 1, 600), (2, None, 0, None)]


def test_voucher_null_min_order_rejects_and_zero_cap(spark):
    v = spark.createDataFrame(
        [(1, "NOMIN", "fixed", Decimal(1000), None, None, None, 0, None, True),
         (2, "CAP0", "percent", Decimal(50), Decimal(0), Decimal(0), None, 0, None, True)],
        "voucher_id long, code string, discount_type string, discount_value decimal(10,2), "
        "max_discount decimal(10,0), min_order decimal(10,0), max_uses int, used_count int, "
        "expires_at date, is_active boolean")
    ts = dt.datetime(2025, 1, 1)
    o = spark.createDataFrame([(1, "nomin", Decimal(5000), ts), (2, "cap0", Decimal(5000), ts)],
                              "order_id long, voucher_code string, subtotal decimal(18,2), created_at timestamp_ntz")
    out = rows(pricing.apply_voucher(o, v, as_of="2025-01-01"), "order_id", "discount", "applied_voucher_id")
    assert out == [(1, 0, None), (2, 0, 2)]


def test_first_event_is_not_a_transition(spark):
    t0 = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame([(1, 1, "preparing", t0), (2, 1, "ready", t0 + dt.timedelta(minutes=1)),
                                (3, 1, "preparing", t0 + dt.timedelta(minutes=2)),
                                (4, 1, "preparing", t0 + dt.timedelta(minutes=3))],
                               "event_id long, order_id long, status string, ts timestamp_ntz")
    assert rows(orders.status_transitions(ev, "preparing"), "event_id") == [(3,)]


def test_menu_filter_all_and_blank(bound):
    from mealops.operators import menu
    assert menu.menu_filter(bound.products, tag="all", q="  ").count() == bound.products.count()


def test_durations_ignore_session_time_zone(spark):
    ev = spark.createDataFrame([(1, 1, "pending", "2024-03-10 01:30:00"), (2, 1, "confirmed", "2024-03-10 03:30:00")],
                               "event_id long, order_id long, status string, ts string")
    ev = ev.withColumn("ts", ev.ts.cast("timestamp_ntz"))
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")   # DST starts 02:00 that day
        out = rows(orders.status_durations(ev), "step", "minutes")
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert out == [("pending->confirmed", 120.0)]


# ------------------------------------------------- null keys, ties and caps

LEDGER = ("inventory_id long, order_id long, line_no int, action_type string, quantity_change decimal(10,2), "
          "created_at timestamp_ntz")


def ledger(spark):
    t = dt.datetime(2025, 1, 1)
    rws = [(1, 1, 1, "import", Decimal(5), t), (1, 2, 1, "export", Decimal(-2), None),
           (None, 3, 1, "import", Decimal(7), t), (None, 4, 1, "export", Decimal(-1), t + dt.timedelta(hours=3)),
           (1, 5, 1, "export", Decimal(-1), t + dt.timedelta(hours=2)), (None, 6, 1, "waste", Decimal(-3), None)]
    return spark.createDataFrame(rws, LEDGER)


def test_window_helpers_keep_null_keys_and_buckets(spark):
    from mealops.functions import windows as W
    df, order = ledger(spark), ["created_at", "order_id"]
    for bucket in (W.time_bucket("created_at"), F.lit(None).cast("int")):
        one = W.prefix_sums(df, ["inventory_id"], order, None, {"s": F.col("quantity_change")}, seq="n")
        two = W.prefix_sums(df, ["inventory_id"], order, bucket, {"s": F.col("quantity_change")}, seq="n")
        assert sorted(map(str, one.collect())) == sorted(map(str, two.select(*one.columns).collect()))
        one = W.previous_values(df, ["inventory_id"], order, None, ["action_type"])
        two = W.previous_values(df, ["inventory_id"], order, bucket, ["action_type"])
        assert sorted(map(str, one.collect())) == sorted(map(str, two.select(*one.columns).collect()))
        src = df.withColumn("v", F.when(F.col("order_id") % 2 == 0, F.col("order_id")))
        one = W.last_non_null(src, ["inventory_id"], order, None, "v", "f")
        two = W.last_non_null(src, ["inventory_id"], order, bucket, "v", "f")
        assert sorted(map(str, one.collect())) == sorted(map(str, two.select(*one.columns).collect()))


def test_stock_running_balance_keeps_undated_rows(spark):
    assert stock.stock_running_balance(ledger(spark)).count() == 6


def test_labels_past_99_items_stay_apart(spark):
    o = spark.createDataFrame([(1,)], "order_id long")
    items = spark.createDataFrame(
        [(1, i, 1, 1, Decimal(1), 100, Decimal(1), Decimal(1), Decimal(1)) for i in range(1, 106)],
        "order_id long, line_no int, product_id long, quantity int, subtotal decimal(18,2), calories_snapshot int, "
        "protein_snapshot decimal(5,1), carbs_snapshot decimal(5,1), fat_snapshot decimal(5,1)")
    p = spark.createDataFrame([(1, "dish")], "product_id long, name string")
    labels = {r.label_id for r in orders.label_rows(o, items, p).collect()}
    assert len(labels) == 105 and {"#1-01", "#1-99", "#1-100", "#1-105"} <= labels


def test_lifecycle_event_at_the_subscription_time_applies(spark):
    from mealops.operators import subs
    t = dt.datetime(2025, 1, 1)
    s = spark.createDataFrame([(50, 7, 1, t.date(), dt.date(2026, 1, 1), "active", t)],
                              "subscription_id long, user_id long, plan_id int, start_date date, end_date date, "
                              "status string, created_at timestamp_ntz")
    e = spark.createDataFrame([(3, 7, "cancel", t)], "event_id long, user_id long, action string, ts timestamp_ntz")
    assert subs.subscription_lifecycle(s, e, as_of="2025-02-01").first().status == "cancelled"


def test_merge_rejects_rows_without_a_key(spark):
    from mealops.sources import sinks
    cur = spark.createDataFrame([(1, "a")], "k long, name string")
    feed = spark.createDataFrame([(None, "x", 1), (2, "b", 2)], "k long, name string, seq int")
    merged, rejects = sinks.merge_dimension(cur, feed, key="k", required=["name"], order=["seq"])
    assert rows(merged, "k", "name") == [(1, "a"), (2, "b")]
    assert [r.reason for r in rejects.collect()] == ["missing k"]


def test_zero_totals_give_null_shares(spark):
    z = spark.createDataFrame([("a", 0), ("b", 0)], "k string, v long")
    assert {r.share for r in reports.share_of_total(z, "k", "v").collect()} == {None}
    assert {r.pct for r in reports.ratio_to_max(z, "k", "v").collect()} == {None}
    none = stock.food_waste_pct(ledger(spark).filter("action_type = 'import'").withColumn(
        "action_type", F.lit("export")).withColumn("quantity_change", F.lit(0).cast("decimal(10,2)")),
        date_from="2025-01-01", date_to="2025-01-02")
    assert none.first().waste_pct is None


def test_load_tables_names_the_missing_table(spark, tmp_path):
    import pytest
    from mealops.sources import sinks
    with pytest.raises(Exception, match="users.parquet"):
        sinks.load_tables(spark, str(tmp_path), ["users"])


def test_receipt_codes_are_unique(bound):
    assert bound.receipts.count() == bound.receipts.select("receipt_id").distinct().count()


def test_menu_week_counts_ingredients_without_a_name(spark, bound):
    from mealops.operators import menu
    plan = spark.createDataFrame([(1, None, Decimal(20)), (2, "TOTAL", Decimal(3)), (None, "TOTAL", Decimal(23))],
                                 "inventory_id long, name string, shortfall decimal(10,2)")
    r = menu.menu_week_stats(bound.menu_schedule, bound.products, bound.subscriptions, plan, week_start="1998-01-05")
    assert r.first().buy_qty == 23


def test_create_orders_accounts_for_every_request(bound):
    f = pricing.create_orders(bound.order_requests, bound.order_request_items, bound.products, bound.vouchers,
                              as_of="2001-08-01")
    assert f["orders"].count() + f["rejects"].count() == bound.order_requests.count()
    assert f["rejects"].count() > 0 and f["orders"].filter("subtotal is null").count() == 0


def test_zero_discount_usage_is_kept(spark):
    t = dt.datetime(2025, 1, 1)
    req = spark.createDataFrame([(1, 9, "cap0", t)], "order_id long, user_id long, voucher_code string, created_at timestamp_ntz")
    it = spark.createDataFrame([(1, 1, '[{"product_id":5,"qty":2}]')], "order_id long, line_no int, items_json string")
    p = spark.createDataFrame([(5, Decimal(3000), 1, Decimal(1), Decimal(1), Decimal(1))],
                              "product_id long, price decimal(18,2), calories int, protein_g decimal(5,1), "
                              "carbs_g decimal(5,1), fat_g decimal(5,1)")
    v = spark.createDataFrame([(2, "CAP0", "percent", Decimal(50), Decimal(0), Decimal(0), None, 0, None, True)],
                              "voucher_id long, code string, discount_type string, discount_value decimal(10,2), "
                              "max_discount decimal(10,0), min_order decimal(10,0), max_uses int, used_count int, "
                              "expires_at date, is_active boolean")
    f = pricing.create_orders(req, it, p, v, as_of="2025-01-01")
    assert rows(f["voucher_usages"], "voucher_id", "discount_amount") == [(2, 0)]
    assert rows(f["voucher_counts"], "voucher_id", "used_count") == [(2, 1)]


def test_session_keeps_the_launcher_master():
    import subprocess
    import sys
    code = ("from pyspark.sql import SparkSession\n"
            "SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
            "from mealops.session import get_session\n"
            "s = get_session()\nprint('MASTER', s.sparkContext.master, s.sparkContext.getConf().get('spark.driver.bindAddress', 'unset'))")
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=180, cwd=ROOT)
    assert "MASTER local[2] unset" in out.stdout


def test_csv_export_header_once_per_part(spark, tmp_path):
    from mealops.sources import sinks
    df = spark.range(0, 50, 1, 4).withColumnRenamed("id", "n")
    path = str(tmp_path / "csv")
    assert sinks.export_csv(df, path)
    import glob
    parts = sorted(glob.glob(f"{path}/part-*"))
    assert len(parts) == 4
    for part in parts:
        lines = open(part, encoding="utf-8").read().splitlines()
        assert lines[0] == sinks.BOM + "n" and all(x.startswith('"') for x in lines[1:])
    assert not sinks.export_csv(df.limit(0), str(tmp_path / "none"))
