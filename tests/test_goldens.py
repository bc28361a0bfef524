"""Hand-computed goldens from the reference pages and seed data."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from support import rows
from mealops.operators import customers, orders, pricing, promo, stock, subs


def test_ingredient_plan_golden(spark):
    # (name, need, stock, price per kg) from the menu-plan page.
    data = [("Ức gà", 42, 12, 85000), ("Cá hồi fillet", 18, 3, 320000), ("Bơ Hass", 12, 2, 95000),
            ("Gạo lứt", 25, 20, 28000), ("Quinoa", 8, 1, 180000), ("Xà lách butter", 10, 2, 45000),
            ("Bông cải xanh", 15, 8, 35000), ("Bò thăn", 20, 0, 260000)]
    need = spark.createDataFrame([(i, Decimal(n)) for i, (_, n, _, _) in enumerate(data)],
                                 "inventory_id long, need decimal(18,3)")
    inv = spark.createDataFrame([(i, nm, Decimal(s), Decimal(p)) for i, (nm, _, s, p) in enumerate(data)],
                                "inventory_id long, name string, quantity decimal(10,2), unit_price decimal(18,2)")
    out = {r["inventory_id"]: r for r in stock.ingredient_plan(need, inv).collect()}
    assert [int(out[i]["shortfall"]) for i in range(8)] == [30, 15, 10, 5, 7, 8, 7, 20]
    assert [int(out[i]["cost"]) for i in range(8)] == [2550000, 4800000, 950000, 140000, 1260000,
                                                       360000, 245000, 5200000]
    assert [out[i]["band"] for i in range(8)] == ["red", "red", "red", "ok", "red", "red", "mid", "red"]
    total = out[None]
    assert total["name"] == "TOTAL" and int(total["cost"]) == 15505000 and total["band"] is None


def test_forecast_golden(spark):
    cur = spark.createDataFrame([(1, 42, 18), (2, 18, 32), (3, 12, 9), (4, 8, 25), (5, 20, 14)],
                                "inventory_id int, current long, growth long")
    out = rows(stock.forecast_ingredients(cur), "inventory_id", "next_week", "urgent")
    assert [r[1] for r in out] == [50, 24, 13, 10, 23]
    assert [r[0] for r in out if r[2]] == [2, 4]


def test_subscription_report_golden(spark):
    month_start, before = dt.date(2024, 1, 1), dt.date(2023, 12, 20)
    spec = {1: (48, 12, 3), 2: (73, 18, 5), 3: (29, 7, 1)}   # active, new, cancelled
    data, sid = [], 0
    for plan, (active, new, cancelled) in spec.items():
        new_active = new - cancelled
        for i in range(active):
            start = month_start + dt.timedelta(days=2) if i < new_active else before
            data.append((sid, plan, start, start + dt.timedelta(days=30), "active")); sid += 1
        for _ in range(cancelled):
            data.append((sid, plan, month_start + dt.timedelta(days=3), month_start + dt.timedelta(days=10), "cancelled")); sid += 1
    s = spark.createDataFrame(data, "subscription_id long, plan_id int, start_date date, end_date date, status string")
    plans = spark.createDataFrame([(1, Decimal(490000)), (2, Decimal(820000)), (3, Decimal(1150000))],
                                  "plan_id int, price_weekly decimal(10,0)")
    out = {r["plan_id"]: r for r in subs.subscription_report(s, plans, month="2024-01").collect()}
    assert [(out[p]["active"], out[p]["new"], out[p]["cancelled"]) for p in (1, 2, 3)] == list(spec.values())
    assert [round(out[p]["retention"], 1) for p in (1, 2, 3)] == [93.8, 93.2, 96.6]
    assert [int(out[p]["revenue"]) for p in (1, 2, 3)] == [23520000, 59860000, 33350000]


def test_voucher_usage_rate_golden(spark):
    v = spark.createDataFrame([(1, "HEALTHY20", 47, 100, None), (2, "NEWUSER50K", 23, 50, None),
                               (3, "KETO30", 15, 30, None), (4, "SUMMER10", 100, 100, dt.date(2025, 5, 1))],
                              "voucher_id long, code string, used_count int, max_uses int, expires_at date")
    out = rows(promo.voucher_usage_rate(v, as_of="2025-05-18"), "voucher_id", "rate", "hot", "expired")
    assert [round(r[1], 2) for r in out] == [0.47, 0.46, 0.50, 1.00]
    assert [r[2] for r in out] == [False, False, False, True]
    assert [r[3] for r in out] == [False, False, False, True]


def _seed_vouchers(spark):
    return spark.createDataFrame(
        [(1, "HEALTHY20", "percent", Decimal(20), None, Decimal(150000), 100, 0, dt.date(2025, 6, 30), True),
         (2, "NEWUSER50K", "fixed", Decimal(50000), None, Decimal(200000), 50, 0, dt.date(2025, 6, 30), True),
         (3, "KETO30", "percent", Decimal(30), None, Decimal(250000), 30, 0, dt.date(2025, 6, 15), True)],
        "voucher_id long, code string, discount_type string, discount_value decimal(10,2), "
        "max_discount decimal(10,0), min_order decimal(10,0), max_uses int, used_count int, "
        "expires_at date, is_active boolean")


def test_apply_voucher_golden(spark):
    ts = dt.datetime(2025, 6, 1, 12, 0)
    o = spark.createDataFrame([(1, "healthy20", Decimal(255000), ts), (2, "NEWUSER50K", Decimal(255000), ts),
                               (3, " keto30 ", Decimal(255000), ts), (4, "NOPE", Decimal(255000), ts)],
                              "order_id long, voucher_code string, subtotal decimal(18,2), created_at timestamp_ntz")
    out = rows(pricing.apply_voucher(o, _seed_vouchers(spark), as_of="2025-06-01"), "order_id", "discount", "total")
    assert [int(r[1]) for r in out] == [51000, 50000, 76500, 0]
    assert [int(r[2]) for r in out] == [204000, 205000, 178500, 255000]


def test_voucher_uses_left_go_to_earliest(spark):
    v = _seed_vouchers(spark).withColumn("used_count", F.when(F.col("code") == "KETO30", 29).otherwise(0))
    t0 = dt.datetime(2025, 6, 1, 8, 0)
    o = spark.createDataFrame([(i, "KETO30", Decimal(300000), t0 + dt.timedelta(hours=i)) for i in range(3)],
                              "order_id long, voucher_code string, subtotal decimal(18,2), created_at timestamp_ntz")
    out = rows(pricing.apply_voucher(o, v, as_of="2025-06-01"), "order_id", "discount")
    assert [int(r[1]) for r in out] == [90000, 0, 0]


def test_loyalty_golden(spark):
    o = spark.createDataFrame([(1, 10, Decimal(255000), Decimal(0)), (2, 10, Decimal(9999), Decimal(0)),
                               (3, None, Decimal(500000), Decimal(0))],
                              "order_id long, user_id long, subtotal decimal(18,2), discount_amount decimal(18,2)")
    assert rows(pricing.loyalty_accrual(o), "order_id", "points") == [(1, 25)]


def test_kitchen_ticket_golden(spark):
    now = dt.datetime(2025, 6, 1, 12, 0)
    ev = spark.createDataFrame([(i + 1, i + 1, "pending", now - dt.timedelta(minutes=m)) for i, m in enumerate([8, 14, 2])],
                               "event_id long, order_id long, status string, ts timestamp_ntz")
    out = rows(orders.kitchen_ticket_priority(ev, as_of="2025-06-01 12:00:00"), "order_id", "elapsed_min", "priority", "urgent")
    assert out == [(1, 8, "normal", False), (2, 14, "medium", False), (3, 2, "normal", False)]


def test_daily_nutrition_bands(spark):
    kcal = [1850, 2100, 1650, 1920, 2050, 1800, 1520]
    day0 = dt.datetime(2025, 6, 2)
    o = spark.createDataFrame([(i, 1, "done", day0 + dt.timedelta(days=i)) for i in range(7)],
                              "order_id long, user_id long, status string, created_at timestamp_ntz")
    items = spark.createDataFrame([(i, 1, k, Decimal(0), Decimal(0), Decimal(0)) for i, k in enumerate(kcal)],
                                  "order_id long, quantity int, calories_snapshot int, protein_snapshot decimal(5,1), "
                                  "carbs_snapshot decimal(5,1), fat_snapshot decimal(5,1)")
    out = rows(customers.daily_nutrition(o, items), "day", "band")
    assert [r[1] for r in out] == ["ok", "high", "ok", "ok", "high", "ok", "ok"]
