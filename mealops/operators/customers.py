"""Customer metrics: retention, frequency, nutrition, carts, activity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import lit_date

# Daily nutrition targets (kcal, protein g, carbs g, fat g).
TARGETS = {"kcal": 2000, "protein": 100, "carbs": 200, "fat": 65}
# Calorie bands (> 2000 high, < 1500 low, else ok).
KCAL_HIGH, KCAL_LOW = 2000, 1500


def _counting(orders: DataFrame) -> DataFrame:
    return orders.filter((F.col("status") != "cancelled") & F.col("user_id").isNotNull())


def retention_rate(orders: DataFrame, *, as_of, days: int) -> DataFrame:
    """Share of previous-period buyers who buy again in the current period.

    Periods: [as_of − 2·days, as_of − days) and [as_of − days, as_of). One
    aggregate per user marks both periods.
    """
    now = lit_date(as_of)
    mid, lo = F.date_sub(now, days), F.date_sub(now, 2 * days)
    d = F.to_date("created_at")
    o = _counting(orders).filter((d >= lo) & (d < now))
    per_user = o.groupBy("user_id").agg(F.max(d < mid).alias("prev"), F.max(d >= mid).alias("cur"))
    a = per_user.agg(F.count_if("prev").alias("previous_buyers"),
                     F.count_if(F.col("prev") & F.col("cur")).alias("kept"))
    return a.select("previous_buyers", "kept",
                    F.try_divide(F.col("kept").cast("double"),
                                 F.nullif(F.col("previous_buyers").cast("double"), F.lit(0.0))).alias("rate"))


def order_frequency(orders: DataFrame) -> DataFrame:
    """Per month: buying customers, orders and average orders per customer."""
    per = (_counting(orders).groupBy(F.date_format("created_at", "yyyy-MM").alias("month"), "user_id")
           .agg(F.count(F.lit(1)).alias("n")))
    return per.groupBy("month").agg(F.count(F.lit(1)).alias("customers"), F.sum("n").alias("orders")).select(
        "month", "customers", "orders", (F.col("orders") / F.col("customers")).alias("avg_orders"))


def _order_nutrition(order_items: DataFrame) -> DataFrame:
    q = F.col("quantity")
    return order_items.groupBy("order_id").agg(
        F.sum(q.cast("bigint") * F.col("calories_snapshot")).alias("kcal"),
        F.sum(q * F.col("protein_snapshot")).alias("protein"),
        F.sum(q * F.col("carbs_snapshot")).alias("carbs"),
        F.sum(q * F.col("fat_snapshot")).alias("fat"))


def customer_stats(orders: DataFrame, order_items: DataFrame) -> DataFrame:
    """Per user: orders, spent, average kcal per ordering day, first order day."""
    o = _counting(orders).select("order_id", "user_id", "total", F.to_date("created_at").alias("day"))
    j = o.join(_order_nutrition(order_items).select("order_id", "kcal"), "order_id", "left")
    g = j.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("total").alias("spent"),
        F.sum("kcal").alias("kcal"), F.count_distinct("day").alias("days"), F.min("day").alias("first_day"))
    return g.select("user_id", "orders", "spent",
                    (F.col("kcal").cast("double") / F.col("days")).alias("avg_kcal_day"), "first_day")


def daily_nutrition(orders: DataFrame, order_items: DataFrame) -> DataFrame:
    """Per user and day: kcal and macros from snapshots, % of targets, calorie band."""
    o = _counting(orders).select("order_id", "user_id", F.to_date("created_at").alias("day"))
    j = o.join(_order_nutrition(order_items), "order_id")
    g = j.groupBy("user_id", "day").agg(*[F.sum(c).alias(c) for c in ("kcal", "protein", "carbs", "fat")])
    pct = [(F.col(c).cast("double") * 100.0 / F.lit(float(t))).alias(f"{c}_pct") for c, t in TARGETS.items()]
    band = F.when(F.col("kcal") > KCAL_HIGH, "high").when(F.col("kcal") < KCAL_LOW, "low").otherwise("ok")
    return g.select("user_id", "day", "kcal", "protein", "carbs", "fat", *pct, band.alias("band"))


def meal_history(orders: DataFrame, order_items: DataFrame, products: DataFrame) -> DataFrame:
    """Every eaten item: user, day, HH:mm, name, meal type by hour, kcal.

    Fixed values (our bands): before 10h breakfast, before 14h lunch,
    before 18h snack, else dinner.
    """
    o = _counting(orders).select("order_id", "user_id", "created_at")
    p = products.select("product_id", "name")
    j = order_items.select("order_id", "product_id", "quantity", "calories_snapshot").join(o, "order_id").join(p, "product_id")
    h = F.hour("created_at")
    meal = F.when(h < 10, "breakfast").when(h < 14, "lunch").when(h < 18, "snack").otherwise("dinner")
    return j.select("user_id", F.to_date("created_at").alias("day"),
                    F.date_format("created_at", "HH:mm").alias("time"), "name", meal.alias("meal_type"),
                    (F.col("quantity") * F.col("calories_snapshot")).alias("kcal"))


def cart_fold(events: DataFrame) -> DataFrame:
    """Fold cart events into final cart lines (user_id, product_id, qty, notes).

    ``events``: (event_id, user_id, product_id, action, qty, notes, ts) with
    action add / set / clear. add on an existing line adds qty and keeps the
    first notes; set with qty ≤ 0 removes the line, with qty > 0 replaces
    the quantity of an existing line (no-op otherwise); clear empties the
    cart. Every step is an aggregate per user or per (user, product) plus a
    key join, so no list of events is ever gathered for one cart.
    """
    pos = F.struct("ts", "event_id")
    k = ["user_id", "product_id"]
    clears = (events.filter(F.col("action") == "clear").groupBy("user_id")
              .agg(F.max(pos).alias("_clear")))
    e = (events.filter(F.col("action") != "clear").join(clears, "user_id", "left")
         .filter(F.col("_clear").isNull() | (pos > F.col("_clear"))).drop("_clear"))
    removing = (F.col("action") == "set") & (F.col("qty") <= 0)
    seg = e.groupBy(*k).agg(F.max(F.when(removing, pos)).alias("_seg"))
    e = e.join(seg, k).filter(F.col("_seg").isNull() | (pos > F.col("_seg"))).drop("_seg")
    is_add = F.col("action") == "add"
    first = e.groupBy(*k).agg(F.min(F.when(is_add, pos)).alias("_first"),
                              F.min_by("notes", F.when(is_add, pos)).alias("_notes"))
    first = first.filter(F.col("_first").isNotNull())
    e = e.join(first, k).filter(pos >= F.col("_first"))
    setting = (F.col("action") == "set") & (F.col("qty") > 0)
    last_set = e.groupBy(*k).agg(F.max(F.when(setting, pos)).alias("_set"),
                                 F.max_by("qty", F.when(setting, pos)).alias("_set_qty"))
    e = e.join(last_set, k)
    after = is_add & (F.col("_set").isNull() | (pos > F.col("_set")))
    g = e.groupBy(*k).agg(F.first("_set_qty", ignorenulls=True).alias("_set_qty"),
                          F.sum(F.when(after, F.col("qty"))).alias("_adds"),
                          F.first("_notes", ignorenulls=True).alias("notes"))
    qty = (F.coalesce("_set_qty", F.lit(0)) + F.coalesce("_adds", F.lit(0))).cast("bigint")
    return g.select(*k, qty.alias("qty"), "notes")


def cart_totals(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Per cart: Σ price × qty, Σ kcal × qty (missing kcal = 0), Σ qty."""
    p = products.select("product_id", "price", "calories")
    j = lines.join(p, "product_id")
    return j.groupBy("user_id").agg(
        F.sum(F.col("price") * F.col("qty")).alias("total"),
        F.sum(F.coalesce("calories", F.lit(0)) * F.col("qty")).cast("bigint").alias("kcal"),
        F.sum("qty").cast("bigint").alias("n"))


def last_activity(logins: DataFrame) -> DataFrame:
    return logins.groupBy("user_id").agg(F.max("login_at").alias("last_login"))
