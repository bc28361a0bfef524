"""Reports and KPIs over orders, stock and subscriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import dbl, lit_date, money, not_cancelled, ratio, with_scalars


def revenue_report(orders: DataFrame, *, date_from, date_to) -> DataFrame:
    """Per day in [date_from, date_to], cancelled orders excluded.

    The day predicate is written on ``created_at`` itself (half-open range),
    so it reaches the parquet scan as a pushed filter.
    """
    lo = lit_date(date_from).cast("timestamp_ntz")
    hi = F.date_add(lit_date(date_to), 1).cast("timestamp_ntz")
    o = orders.filter((F.col("created_at") >= lo) & (F.col("created_at") < hi) & not_cancelled())
    return (o.groupBy(F.to_date("created_at").alias("report_date"))
            .agg(F.count(F.lit(1)).alias("total_orders"),
                 F.sum(money("total")).alias("rev"),
                 F.sum(money("discount_amount")).alias("disc"),
                 F.count_if(F.col("order_type") == "online").alias("online_orders"),
                 F.count_if(F.col("order_type") == "walkin").alias("walkin_orders"))
            .select("report_date", "total_orders",
                    dbl("rev").alias("total_revenue"),
                    dbl("disc").alias("total_discount"),
                    (dbl("rev") / F.col("total_orders")).alias("avg_order_value"),
                    "online_orders", "walkin_orders"))


def _scalar_join(df: DataFrame, *one_row_frames: DataFrame) -> DataFrame:
    """``df`` with the columns of one-row aggregates attached (scalar subqueries, no join)."""
    return with_scalars(df, *one_row_frames)


def period_filter(df: DataFrame, *, as_of, days: int, ts_col: str = "created_at") -> DataFrame:
    """Rows in the half-open window [as_of − days, as_of)."""
    now = lit_date(as_of)
    return df.filter((F.col(ts_col) >= F.date_sub(now, days).cast("timestamp_ntz"))
                     & (F.col(ts_col) < now.cast("timestamp_ntz")))


def kpi_single_row(orders: DataFrame, users: DataFrame, products: DataFrame,
                   active_subs: DataFrame, inventory: DataFrame) -> DataFrame:
    """Five independent scalar aggregates side by side in one row."""
    return _scalar_join(
        orders.agg(F.count(F.lit(1)).alias("total_orders")),
        users.agg(F.count_if(F.col("role") == "customer").alias("customers")),
        products.agg(F.count_if("is_available").alias("available_products")),
        active_subs.agg(F.count(F.lit(1)).alias("active_subscriptions")),
        inventory.agg(F.count(F.lit(1)).alias("inventory_items")))


def nutrient_needs(orders: DataFrame, order_items: DataFrame, products: DataFrame, *,
                   date_from, date_to) -> DataFrame:
    """Per product, not cancelled, in [from, to]: portions and macro needs (current macros)."""
    lo = lit_date(date_from).cast("timestamp_ntz")
    hi = F.date_add(lit_date(date_to), 1).cast("timestamp_ntz")
    o = orders.filter((F.col("created_at") >= lo) & (F.col("created_at") < hi) & not_cancelled()).select("order_id")
    portions = (order_items.join(o, "order_id", "left_semi").groupBy("product_id")
                .agg(F.sum("quantity").cast("bigint").alias("total_portions")))
    p = products.select("product_id", F.col("name").alias("product_name"), "calories", "protein_g", "carbs_g", "fat_g")
    j = portions.join(p, "product_id")
    n = F.col("total_portions")
    return j.select("product_id", "product_name", "total_portions", F.col("calories").alias("cal_per_portion"),
                    (n * F.col("protein_g")).alias("protein_needed_g"),
                    (n * F.col("carbs_g")).alias("carbs_needed_g"),
                    (n * F.col("fat_g")).alias("fat_needed_g"))


def dashboard_kpi(orders: DataFrame, subs: DataFrame, inv_status: DataFrame, *, as_of, subs_as_of=None) -> DataFrame:
    """Revenue and orders of the as_of day, active subscriptions, critical and low-stock items."""
    day = lit_date(as_of)
    sd = lit_date(subs_as_of or as_of)
    o = orders.filter((F.col("created_at") >= day.cast("timestamp_ntz"))
                      & (F.col("created_at") < F.date_add(day, 1).cast("timestamp_ntz")) & not_cancelled())
    return _scalar_join(
        o.agg(F.coalesce(F.sum("total"), F.lit(0).cast("decimal(28,2)")).alias("revenue_today"),
              F.count(F.lit(1)).alias("orders_today")),
        subs.agg(F.count_if((F.col("status") == "active") & sd.between(F.col("start_date"), F.col("end_date")))
                 .alias("active_subscriptions")),
        inv_status.agg(F.count_if(F.col("expiry_status") == "critical").alias("critical_inventory"),
                       F.count_if(F.col("stock_status") == "low_stock").alias("low_stock_items")))


def kpi_change(orders: DataFrame, *, as_of, days: int, inverted=()) -> DataFrame:
    """revenue, orders and average order value of the period vs the previous one.

    change = (value − previous) / previous × 100 (NULL when previous is 0);
    direction up/down/flat; is_good = up, except for metrics in ``inverted``.
    """
    now = lit_date(as_of)
    d = F.to_date("created_at")
    mid, lo = F.date_sub(now, days), F.date_sub(now, 2 * days)
    o = orders.filter(not_cancelled() & (d >= lo) & (d < now))
    cur, prev = d >= mid, d < mid
    a = o.agg(F.sum(F.when(cur, F.col("total"))).alias("rev_c"), F.sum(F.when(prev, F.col("total"))).alias("rev_p"),
              F.count_if(cur).alias("n_c"), F.count_if(prev).alias("n_p"))
    rows = F.array(
        F.struct(F.lit("revenue").alias("metric"), dbl(F.coalesce("rev_c", F.lit(0))).alias("value"),
                 dbl(F.coalesce("rev_p", F.lit(0))).alias("previous")),
        F.struct(F.lit("orders").alias("metric"), dbl("n_c").alias("value"), dbl("n_p").alias("previous")),
        F.struct(F.lit("avg_order_value").alias("metric"),
                 F.coalesce(dbl("rev_c") / F.nullif(F.col("n_c"), F.lit(0)), F.lit(0.0)).alias("value"),
                 F.coalesce(dbl("rev_p") / F.nullif(F.col("n_p"), F.lit(0)), F.lit(0.0)).alias("previous")))
    r = a.select(F.inline(rows))
    change = F.try_divide((F.col("value") - F.col("previous")) * 100.0, F.nullif(F.col("previous"), F.lit(0.0)))
    direction = (F.when(F.col("value") > F.col("previous"), "up")
                 .when(F.col("value") < F.col("previous"), "down").otherwise("flat"))
    inv = F.col("metric").isin(*inverted) if inverted else F.lit(False)
    good = F.when(inv, direction == "down").otherwise(direction == "up")
    return r.select("metric", "value", "previous", change.alias("change"), direction.alias("direction"),
                    good.alias("is_good"))


def product_performance(order_items: DataFrame, products: DataFrame) -> DataFrame:
    """Per product: orders, sold, revenue (current price × sold), % of all revenue, first tag."""
    from ..sources.parse import tags_array
    per = order_items.groupBy("product_id").agg(
        F.count_distinct("order_id").alias("orders"), F.sum("quantity").cast("bigint").alias("sold"))
    p = products.select("product_id", "name", "price", F.element_at(tags_array(), 1).alias("category"))
    j = per.join(p, "product_id").withColumn("revenue", F.col("price") * F.col("sold"))
    total = j.agg(F.sum("revenue").alias("_total"))
    return _scalar_join(j, total).select(
        "product_id", "name", "category", "orders", "sold", "revenue",
        ratio(dbl("revenue") * 100.0, "_total").alias("share"))


def top_products(order_items: DataFrame, products: DataFrame, k: int = 5) -> DataFrame:
    """The k best sellers by quantity (ties by product_id) with rank 1..k."""
    from pyspark.sql import Window
    sold = order_items.groupBy("product_id").agg(F.sum("quantity").cast("bigint").alias("sold"))
    top = sold.orderBy(F.col("sold").desc(), F.col("product_id")).limit(k)
    p = products.select("product_id", "name")
    w = Window.orderBy(F.col("sold").desc(), F.col("product_id"))
    # The window runs over k rows only.
    return top.join(p, "product_id").select(F.row_number().over(w).alias("rank"), "product_id", "name", "sold")


def health_goal_share(orders: DataFrame, order_items: DataFrame, products: DataFrame) -> DataFrame:
    """Portions ordered per health goal (a product's first tag), share of all, top goal flag."""
    from ..sources.parse import tags_array
    o = orders.filter(not_cancelled()).select("order_id")
    p = products.select("product_id", F.element_at(tags_array(), 1).alias("goal"))
    per_product = (order_items.join(o, "order_id", "left_semi").groupBy("product_id")
                   .agg(F.sum("quantity").alias("q")))
    g = per_product.join(p, "product_id").groupBy("goal").agg(F.sum("q").cast("bigint").alias("n"))
    tot = g.agg(F.sum("n").alias("_t"), F.max("n").alias("_m"))
    return _scalar_join(g, tot).select("goal", "n", ratio("n", "_t").alias("share"),
                                       (F.col("n") == F.col("_m")).alias("is_top"))


def hourly_profile(events: DataFrame) -> DataFrame:
    """Average purchases per 2-hour bucket from 7h to 21h (count / days with data)."""
    e = events.filter(F.col("event_type") == "purchase")
    h = F.hour("ts")
    days = e.agg(F.count_distinct(F.to_date("ts")).alias("_days"))
    b = (e.filter((h >= 7) & (h < 21))
         .groupBy((F.lit(7) + F.floor((h - 7) / 2) * 2).cast("int").alias("bucket_start"))
         .agg(F.count(F.lit(1)).alias("n")))
    return _scalar_join(b, days).select("bucket_start", "n", (F.col("n") / F.col("_days")).alias("avg_n"))


# The delivery slots (start hour, end hour, label).
SLOTS = [(7, 9, "07:00 - 09:00"), (9, 11, "09:00 - 11:00"), (11, 13, "11:00 - 13:00"),
         (13, 15, "13:00 - 15:00"), (15, 17, "15:00 - 17:00"), (17, 20, "17:00 - 20:00")]


def peak_timeslot(events: DataFrame) -> DataFrame:
    """Purchases per delivery slot (by hour of the event) and the busiest slot."""
    h = F.hour("ts")
    slot = F.lit(None).cast("string")
    for lo, hi, label in reversed(SLOTS):
        slot = F.when((h >= lo) & (h < hi), label).otherwise(slot)
    e = events.filter(F.col("event_type") == "purchase").select(slot.alias("slot")).filter(F.col("slot").isNotNull())
    g = e.groupBy("slot").agg(F.count(F.lit(1)).alias("n"))
    m = g.agg(F.max("n").alias("_m"))
    return _scalar_join(g, m).select("slot", "n", (F.col("n") == F.col("_m")).alias("is_peak"))


def share_of_total(df: DataFrame, key: str, value: str) -> DataFrame:
    """value / Σ value per key (the total is a one-row aggregate, not a global window)."""
    g = df.groupBy(F.col(key).alias("key")).agg(F.sum(value).alias("value"))
    t = g.agg(F.sum("value").alias("_t"))
    return _scalar_join(g, t).select("key", "value", ratio("value", "_t").alias("share"))


def ratio_to_max(df: DataFrame, key: str, value: str, floor_max=None, by: list[str] | None = None) -> DataFrame:
    """value / max × 100; ``floor_max`` raises the max (e.g. 2000 kcal for the calorie chart).

    With ``by`` the max is taken per group (one chart per user, say): the
    per-group max is an aggregate joined back on the group key; without it
    the max is a scalar subquery.
    """
    by = list(by or [])
    g = df.groupBy(*by, F.col(key).alias("key")).agg(F.sum(value).alias("value"))
    m = (g.groupBy(*by) if by else g).agg(F.max("value").alias("_m"))
    j = g.join(m, by) if by else _scalar_join(g, m)
    mx = dbl("_m") if floor_max is None else F.greatest(dbl("_m"), F.lit(float(floor_max)))
    return j.select(*by, "key", "value", ratio(dbl("value") * 100.0, mx).alias("pct"))


def demand_forecast(orders: DataFrame, order_items: DataFrame, *, as_of, days: int = 30) -> DataFrame:
    """Portions per weekday for next week.

    Mean portions per weekday over the last ``days`` days, times the growth
    of that period over the previous one.
    """
    now = lit_date(as_of)
    d = F.to_date("created_at")
    lo, mid = F.date_sub(now, 2 * days), F.date_sub(now, days)
    o = orders.filter(not_cancelled() & (d >= lo) & (d < now)).select("order_id", d.alias("day"))
    per_day = (order_items.select("order_id", "quantity").join(o, "order_id")
               .groupBy("day").agg(F.sum("quantity").cast("bigint").alias("q")))
    cur = per_day.filter(F.col("day") >= mid)
    tot = per_day.agg(F.sum(F.when(F.col("day") >= mid, F.col("q"))).alias("_c"),
                      F.sum(F.when(F.col("day") < mid, F.col("q"))).alias("_p"))
    # Number of each weekday in the window: a fixed-size date spine.
    spine = (orders.sparkSession.range(1).select(F.explode(F.sequence(mid, F.date_sub(now, 1))).alias("day"))
             .groupBy((F.weekday("day") + 1).alias("dow")).agg(F.count(F.lit(1)).alias("_k")))
    by_dow = cur.groupBy((F.weekday("day") + 1).alias("dow")).agg(F.sum("q").alias("q"))
    growth = F.coalesce(dbl("_c") / F.nullif(dbl("_p"), F.lit(0.0)), F.lit(1.0))
    j = spine.join(by_dow, "dow", "left")
    return _scalar_join(j, tot).select(
        "dow", (F.coalesce(dbl("q"), F.lit(0.0)) / F.col("_k") * growth).alias("portions"))


def daily_revenue_series(orders: DataFrame, *, as_of, days: int = 7) -> DataFrame:
    """Revenue for each of the last ``days`` days up to as_of; empty days are 0."""
    now = lit_date(as_of)
    lo = F.date_sub(now, days - 1)
    d = F.to_date("created_at")
    o = orders.filter(not_cancelled() & (F.col("created_at") >= lo.cast("timestamp_ntz"))
                      & (F.col("created_at") < F.date_add(now, 1).cast("timestamp_ntz")))
    rev = o.groupBy(d.alias("day")).agg(F.sum("total").alias("revenue"))
    spine = rev.sparkSession.range(1).select(F.explode(F.sequence(lo, now)).alias("day"))
    return (spine.join(rev, "day", "left")
            .select("day", F.coalesce(F.col("revenue"), F.lit(0).cast("decimal(28,2)")).alias("revenue")))
