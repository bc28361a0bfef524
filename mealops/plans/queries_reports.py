"""Catalogue entries: customers, suppliers, reports, delivery."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import customers, delivery, reports, stock, subs, suppliers
from .catalog import register

STOCK_AS_OF = "2001-08-01"
SUBS_AS_OF = "2024-01-20"
COUNTING = "status <> 'cancelled' AND user_id IS NOT NULL"


# -------------------------------------------------------------- customers
@register("retention_rate", f"""
, pu AS (SELECT user_id, bool_or(CAST(created_at AS DATE) < DATE '1998-08-01' - 90) AS prev,
                bool_or(CAST(created_at AS DATE) >= DATE '1998-08-01' - 90) AS cur
         FROM orders_b WHERE {COUNTING} AND CAST(created_at AS DATE) >= DATE '1998-08-01' - 180
           AND CAST(created_at AS DATE) < DATE '1998-08-01' GROUP BY user_id),
a AS (SELECT count(*) FILTER (WHERE prev) AS previous_buyers, count(*) FILTER (WHERE prev AND cur) AS kept FROM pu)
SELECT previous_buyers, kept, CAST(kept AS DOUBLE) / nullif(CAST(previous_buyers AS DOUBLE), 0) AS rate FROM a""")
def q_retention_rate(b):
    return customers.retention_rate(b.orders, as_of="1998-08-01", days=90)


@register("order_frequency", f"""
, per AS (SELECT strftime(created_at, '%Y-%m') AS month, user_id, count(*) AS n FROM orders_b WHERE {COUNTING} GROUP BY 1, 2)
SELECT month, count(*) AS customers, CAST(sum(n) AS BIGINT) AS orders, sum(n) / CAST(count(*) AS DOUBLE) AS avg_orders
FROM per GROUP BY month""")
def q_order_frequency(b):
    return customers.order_frequency(b.orders)


ORDER_NUTRITION_SQL = """onut AS (SELECT order_id, CAST(sum(CAST(quantity AS BIGINT) * calories_snapshot) AS BIGINT) AS kcal,
    sum(quantity * protein_snapshot) AS protein, sum(quantity * carbs_snapshot) AS carbs, sum(quantity * fat_snapshot) AS fat
  FROM order_items GROUP BY order_id)"""


@register("customer_stats", f"""
, {ORDER_NUTRITION_SQL},
j AS (SELECT o.user_id, o.total, CAST(o.created_at AS DATE) AS day, n.kcal FROM orders_b o LEFT JOIN onut n ON n.order_id = o.order_id
      WHERE o.{COUNTING.replace(' AND user_id', ' AND o.user_id')})
SELECT user_id, count(*) AS orders, CAST(sum(total) AS DOUBLE) AS spent,
       CAST(sum(kcal) AS DOUBLE) / count(DISTINCT day) AS avg_kcal_day, min(day) AS first_day
FROM j GROUP BY user_id""")
def q_customer_stats(b):
    return customers.customer_stats(b.orders, b.order_items)


@register("daily_nutrition", f"""
, {ORDER_NUTRITION_SQL},
g AS (SELECT o.user_id, CAST(o.created_at AS DATE) AS day, CAST(sum(n.kcal) AS BIGINT) AS kcal, sum(n.protein) AS protein,
             sum(n.carbs) AS carbs, sum(n.fat) AS fat
      FROM orders_b o JOIN onut n ON n.order_id = o.order_id WHERE o.status <> 'cancelled' AND o.user_id IS NOT NULL GROUP BY 1, 2)
SELECT user_id, day, kcal, CAST(protein AS DOUBLE) AS protein, CAST(carbs AS DOUBLE) AS carbs, CAST(fat AS DOUBLE) AS fat,
       CAST(kcal AS DOUBLE) * 100.0 / 2000.0 AS kcal_pct, CAST(protein AS DOUBLE) * 100.0 / 100.0 AS protein_pct,
       CAST(carbs AS DOUBLE) * 100.0 / 200.0 AS carbs_pct, CAST(fat AS DOUBLE) * 100.0 / 65.0 AS fat_pct,
       CASE WHEN kcal > 2000 THEN 'high' WHEN kcal < 1500 THEN 'low' ELSE 'ok' END AS band
FROM g""")
def q_daily_nutrition(b):
    return customers.daily_nutrition(b.orders, b.order_items)


@register("meal_history", """
SELECT o.user_id, CAST(o.created_at AS DATE) AS day, strftime(o.created_at, '%H:%M') AS time, p.name,
       CASE WHEN hour(o.created_at) < 10 THEN 'breakfast' WHEN hour(o.created_at) < 14 THEN 'lunch'
            WHEN hour(o.created_at) < 18 THEN 'snack' ELSE 'dinner' END AS meal_type,
       oi.quantity * oi.calories_snapshot AS kcal
FROM order_items oi JOIN orders_b o ON o.order_id = oi.order_id JOIN products p ON p.product_id = oi.product_id
WHERE o.status <> 'cancelled' AND o.user_id IS NOT NULL""")
def q_meal_history(b):
    return customers.meal_history(b.orders, b.order_items, b.products)


CART_SQL = """cl AS (SELECT user_id, max((ts, event_id)) AS c FROM cart_events WHERE action = 'clear' GROUP BY user_id),
e1 AS (SELECT e.* FROM cart_events e LEFT JOIN cl ON cl.user_id = e.user_id
       WHERE e.action <> 'clear' AND (cl.c IS NULL OR (e.ts, e.event_id) > cl.c)),
sg AS (SELECT user_id, product_id, max(CASE WHEN action = 'set' AND qty <= 0 THEN (ts, event_id) END) AS s FROM e1 GROUP BY 1, 2),
e2 AS (SELECT e1.* FROM e1 JOIN sg USING (user_id, product_id) WHERE sg.s IS NULL OR (e1.ts, e1.event_id) > sg.s),
fa AS (SELECT user_id, product_id, min(CASE WHEN action = 'add' THEN (ts, event_id) END) AS f FROM e2 GROUP BY 1, 2),
e3 AS (SELECT e2.*, fa.f FROM e2 JOIN fa USING (user_id, product_id) WHERE fa.f IS NOT NULL AND (e2.ts, e2.event_id) >= fa.f),
nt AS (SELECT user_id, product_id, notes FROM e3 WHERE (ts, event_id) = f),
ls AS (SELECT user_id, product_id, max(CASE WHEN action = 'set' AND qty > 0 THEN (ts, event_id) END) AS s FROM e3 GROUP BY 1, 2),
lq AS (SELECT e3.user_id, e3.product_id, e3.qty AS set_qty FROM e3 JOIN ls USING (user_id, product_id) WHERE (e3.ts, e3.event_id) = ls.s),
ad AS (SELECT e3.user_id, e3.product_id, sum(e3.qty) FILTER (WHERE e3.action = 'add' AND (ls.s IS NULL OR (e3.ts, e3.event_id) > ls.s)) AS adds
       FROM e3 JOIN ls USING (user_id, product_id) GROUP BY 1, 2),
lines AS (SELECT ad.user_id, ad.product_id, CAST(coalesce(lq.set_qty, 0) + coalesce(ad.adds, 0) AS BIGINT) AS qty, nt.notes
          FROM ad LEFT JOIN lq USING (user_id, product_id) LEFT JOIN nt USING (user_id, product_id))"""


@register("cart_fold", f", {CART_SQL} SELECT * FROM lines")
def q_cart_fold(b):
    return customers.cart_fold(b.cart_events)


@register("cart_totals", f"""
, {CART_SQL}
SELECT l.user_id, CAST(sum(p.price * l.qty) AS DOUBLE) AS total, CAST(sum(coalesce(p.calories, 0) * l.qty) AS BIGINT) AS kcal,
       CAST(sum(l.qty) AS BIGINT) AS n
FROM lines l JOIN products p ON p.product_id = l.product_id GROUP BY l.user_id""")
def q_cart_totals(b):
    return customers.cart_totals(customers.cart_fold(b.cart_events), b.products)


@register("last_activity", "SELECT user_id, max(login_at) AS last_login FROM logins GROUP BY user_id")
def q_last_activity(b):
    return customers.last_activity(b.logins)


# -------------------------------------------------------------- suppliers
@register("suppliers_active", "SELECT supplier_id, name FROM suppliers WHERE is_active")
def q_suppliers_active(b):
    return suppliers.suppliers_active(b.suppliers)


@register("supplier_search", """
SELECT supplier_id, name FROM suppliers
WHERE (contains(lower(name), '#00000') OR contains(lower(coalesce(contact_name, '')), '#00000')) AND category = 3""")
def q_supplier_search(b):
    return suppliers.supplier_search(b.suppliers, q=" #00000", category=3)


@register("supplier_shelf_life", """
SELECT supplier_id, CAST(sum(datediff('day', import_date, expiry_date)) AS DOUBLE) / count(*) AS avg_days,
       CASE WHEN CAST(sum(datediff('day', import_date, expiry_date)) AS DOUBLE) / count(*) <= 3 THEN 'short'
            WHEN CAST(sum(datediff('day', import_date, expiry_date)) AS DOUBLE) / count(*) <= 7 THEN 'medium' ELSE 'long' END AS band
FROM inventory WHERE supplier_id IS NOT NULL GROUP BY supplier_id""")
def q_supplier_shelf_life(b):
    return suppliers.supplier_shelf_life(b.inventory)


@register("supplier_deliveries", """
SELECT i.supplier_id, CAST(l.created_at AS DATE) AS day, i.name AS item, count(*) AS n,
       CAST(sum(l.quantity_change) AS DOUBLE) AS qty
FROM inventory_logs l JOIN inventory i ON i.inventory_id = l.inventory_id
WHERE l.action_type = 'import' AND i.supplier_id IS NOT NULL GROUP BY 1, 2, 3""")
def q_supplier_deliveries(b):
    return suppliers.supplier_deliveries(b.inventory_logs, b.inventory)


# ---------------------------------------------------------------- reports
@register("period_filter", """
SELECT order_id, created_at FROM orders_b
WHERE created_at >= CAST(DATE '2001-08-01' - 90 AS TIMESTAMP) AND created_at < TIMESTAMP '2001-08-01'""")
def q_period_filter(b):
    return reports.period_filter(b.orders, as_of=STOCK_AS_OF, days=90).select("order_id", "created_at")


@register("kpi_single_row", """
SELECT (SELECT count(*) FROM orders_b) AS total_orders,
       (SELECT count(*) FILTER (WHERE role = 'customer') FROM users) AS customers,
       (SELECT count(*) FILTER (WHERE is_available) FROM products) AS available_products,
       (SELECT count(*) FROM subscriptions WHERE status = 'active' AND DATE '2024-01-20' BETWEEN start_date AND end_date) AS active_subscriptions,
       (SELECT count(*) FROM inventory) AS inventory_items""")
def q_kpi_single_row(b):
    return reports.kpi_single_row(b.orders, b.users, b.products,
                                  subs.active_subscriptions_as_of(b.subscriptions, as_of=SUBS_AS_OF), b.inventory)


@register("nutrient_needs", """
, pp AS (SELECT oi.product_id, CAST(sum(oi.quantity) AS BIGINT) AS total_portions
         FROM order_items oi JOIN orders_b o ON o.order_id = oi.order_id
         WHERE CAST(o.created_at AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1998-03-31' AND o.status <> 'cancelled'
         GROUP BY oi.product_id)
SELECT pp.product_id, p.name AS product_name, pp.total_portions, p.calories AS cal_per_portion,
       CAST(pp.total_portions * p.protein_g AS DOUBLE) AS protein_needed_g,
       CAST(pp.total_portions * p.carbs_g AS DOUBLE) AS carbs_needed_g,
       CAST(pp.total_portions * p.fat_g AS DOUBLE) AS fat_needed_g
FROM pp JOIN products p ON p.product_id = pp.product_id""")
def q_nutrient_needs(b):
    return reports.nutrient_needs(b.orders, b.order_lines, b.products, date_from="1998-01-01", date_to="1998-03-31")


@register("dashboard_kpi", """
, ist AS (SELECT CASE WHEN datediff('day', DATE '2001-08-01', expiry_date) <= 1 THEN 'critical'
                      WHEN datediff('day', DATE '2001-08-01', expiry_date) <= 3 THEN 'warning' ELSE 'ok' END AS expiry_status,
                 CASE WHEN quantity <= 0 THEN 'out_of_stock' WHEN quantity <= min_quantity THEN 'low_stock' ELSE 'in_stock' END AS stock_status
          FROM inventory)
SELECT (SELECT CAST(coalesce(sum(total), 0) AS DOUBLE) FROM orders_b WHERE CAST(created_at AS DATE) = DATE '1998-08-02' AND status <> 'cancelled') AS revenue_today,
       (SELECT count(*) FROM orders_b WHERE CAST(created_at AS DATE) = DATE '1998-08-02' AND status <> 'cancelled') AS orders_today,
       (SELECT count(*) FROM subscriptions WHERE status = 'active' AND DATE '2024-01-20' BETWEEN start_date AND end_date) AS active_subscriptions,
       (SELECT count(*) FROM ist WHERE expiry_status = 'critical') AS critical_inventory,
       (SELECT count(*) FROM ist WHERE stock_status = 'low_stock') AS low_stock_items""")
def q_dashboard_kpi(b):
    ist = stock.inventory_status(b.inventory, b.suppliers, as_of=STOCK_AS_OF)
    return reports.dashboard_kpi(b.orders, b.subscriptions, ist, as_of="1998-08-02", subs_as_of=SUBS_AS_OF)


@register("kpi_change", """
, o AS (SELECT *, CAST(created_at AS DATE) >= DATE '1998-08-01' - 30 AS cur FROM orders_b
        WHERE status <> 'cancelled' AND CAST(created_at AS DATE) >= DATE '1998-08-01' - 60 AND CAST(created_at AS DATE) < DATE '1998-08-01'),
a AS (SELECT sum(total) FILTER (WHERE cur) AS rev_c, sum(total) FILTER (WHERE NOT cur) AS rev_p,
             count(*) FILTER (WHERE cur) AS n_c, count(*) FILTER (WHERE NOT cur) AS n_p FROM o),
r AS (SELECT 'revenue' AS metric, CAST(coalesce(rev_c, 0) AS DOUBLE) AS value, CAST(coalesce(rev_p, 0) AS DOUBLE) AS previous FROM a
      UNION ALL SELECT 'orders', CAST(n_c AS DOUBLE), CAST(n_p AS DOUBLE) FROM a
      UNION ALL SELECT 'avg_order_value', coalesce(CAST(rev_c AS DOUBLE) / nullif(n_c, 0), 0.0),
                       coalesce(CAST(rev_p AS DOUBLE) / nullif(n_p, 0), 0.0) FROM a)
SELECT metric, value, previous, (value - previous) * 100.0 / nullif(previous, 0.0) AS change,
       CASE WHEN value > previous THEN 'up' WHEN value < previous THEN 'down' ELSE 'flat' END AS direction,
       value > previous AS is_good FROM r""")
def q_kpi_change(b):
    return reports.kpi_change(b.orders, as_of="1998-08-01", days=30)


@register("product_performance", """
, per AS (SELECT product_id, count(DISTINCT order_id) AS orders, CAST(sum(quantity) AS BIGINT) AS sold FROM order_items GROUP BY product_id),
j AS (SELECT per.*, p.name, from_json(p.health_tags, '["VARCHAR"]')[1] AS category, p.price * per.sold AS revenue
      FROM per JOIN products p ON p.product_id = per.product_id)
SELECT product_id, name, category, orders, sold, CAST(revenue AS DOUBLE) AS revenue,
       CAST(revenue AS DOUBLE) * 100.0 / CAST((SELECT sum(revenue) FROM j) AS DOUBLE) AS share FROM j""")
def q_product_performance(b):
    return reports.product_performance(b.order_lines, b.products)


@register("top_products", """
, s AS (SELECT product_id, CAST(sum(quantity) AS BIGINT) AS sold FROM order_items GROUP BY product_id ORDER BY sold DESC, product_id LIMIT 5)
SELECT CAST(row_number() OVER (ORDER BY s.sold DESC, s.product_id) AS INT) AS rank, s.product_id, p.name, s.sold
FROM s JOIN products p ON p.product_id = s.product_id""")
def q_top_products(b):
    return reports.top_products(b.order_lines, b.products)


@register("health_goal_share", """
, g AS (SELECT from_json(p.health_tags, '["VARCHAR"]')[1] AS goal, CAST(sum(oi.quantity) AS BIGINT) AS n
        FROM order_items oi JOIN orders_b o ON o.order_id = oi.order_id JOIN products p ON p.product_id = oi.product_id
        WHERE o.status <> 'cancelled' GROUP BY 1)
SELECT goal, n, n / CAST((SELECT sum(n) FROM g) AS DOUBLE) AS share, n = (SELECT max(n) FROM g) AS is_top FROM g""")
def q_health_goal_share(b):
    return reports.health_goal_share(b.orders, b.order_lines, b.products)


@register("hourly_profile", """
, e AS (SELECT * FROM events WHERE event_type = 'purchase')
SELECT CAST(7 + floor((hour(ts) - 7) / 2) * 2 AS INT) AS bucket_start, count(*) AS n,
       count(*) / CAST((SELECT count(DISTINCT CAST(ts AS DATE)) FROM e) AS DOUBLE) AS avg_n
FROM e WHERE hour(ts) >= 7 AND hour(ts) < 21 GROUP BY 1""")
def q_hourly_profile(b):
    return reports.hourly_profile(b.raw("events"))


@register("peak_timeslot", """
, e AS (SELECT CASE WHEN hour(ts) >= 7 AND hour(ts) < 9 THEN '07:00 - 09:00' WHEN hour(ts) >= 9 AND hour(ts) < 11 THEN '09:00 - 11:00'
                    WHEN hour(ts) >= 11 AND hour(ts) < 13 THEN '11:00 - 13:00' WHEN hour(ts) >= 13 AND hour(ts) < 15 THEN '13:00 - 15:00'
                    WHEN hour(ts) >= 15 AND hour(ts) < 17 THEN '15:00 - 17:00' WHEN hour(ts) >= 17 AND hour(ts) < 20 THEN '17:00 - 20:00' END AS slot
        FROM events WHERE event_type = 'purchase'),
g AS (SELECT slot, count(*) AS n FROM e WHERE slot IS NOT NULL GROUP BY slot)
SELECT slot, n, n = (SELECT max(n) FROM g) AS is_peak FROM g""")
def q_peak_timeslot(b):
    return reports.peak_timeslot(b.raw("events"))


@register("share_of_total", """
, g AS (SELECT payment_method AS key, sum(total) AS value FROM orders_b GROUP BY 1)
SELECT key, CAST(value AS DOUBLE) AS value, CAST(value AS DOUBLE) / CAST((SELECT sum(value) FROM g) AS DOUBLE) AS share FROM g""")
def q_share_of_total(b):
    return reports.share_of_total(b.orders, "payment_method", "total")


@register("ratio_to_max", """
, g AS (SELECT o.user_id, CAST(o.created_at AS DATE) AS key, CAST(sum(oi.quantity * oi.calories_snapshot) AS BIGINT) AS value
        FROM orders_b o JOIN order_items oi ON oi.order_id = o.order_id
        WHERE o.user_id IS NOT NULL GROUP BY 1, 2),
m AS (SELECT user_id, max(value) AS mx FROM g GROUP BY user_id)
SELECT g.user_id, g.key, g.value, CAST(g.value AS DOUBLE) * 100.0 / greatest(CAST(m.mx AS DOUBLE), 2000.0) AS pct
FROM g JOIN m ON m.user_id = g.user_id""")
def q_ratio_to_max(b):
    # Every customer's calorie chart: each day against max(2000, the customer's best day).
    o = b.orders.filter(F.col("user_id").isNotNull()).select("order_id", "user_id", F.to_date("created_at").alias("day"))
    kcal = b.order_items.join(o, "order_id").select(
        "user_id", "day", (F.col("quantity") * F.col("calories_snapshot")).cast("bigint").alias("kcal"))
    return reports.ratio_to_max(kcal, "day", "kcal", floor_max=2000, by=["user_id"])


@register("demand_forecast", """
, pd AS (SELECT CAST(o.created_at AS DATE) AS day, CAST(sum(oi.quantity) AS BIGINT) AS q
         FROM order_items oi JOIN orders_b o ON o.order_id = oi.order_id
         WHERE o.status <> 'cancelled' AND CAST(o.created_at AS DATE) >= DATE '1998-08-01' - 60 AND CAST(o.created_at AS DATE) < DATE '1998-08-01'
         GROUP BY 1),
t AS (SELECT sum(q) FILTER (WHERE day >= DATE '1998-08-01' - 30) AS c, sum(q) FILTER (WHERE day < DATE '1998-08-01' - 30) AS p FROM pd),
sp AS (SELECT isodow(d) AS dow, count(*) AS k FROM (SELECT unnest(generate_series(DATE '1998-08-01' - 30, DATE '1998-08-01' - 1, INTERVAL 1 DAY)) AS d) x GROUP BY 1),
bd AS (SELECT isodow(day) AS dow, sum(q) AS q FROM pd WHERE day >= DATE '1998-08-01' - 30 GROUP BY 1)
SELECT CAST(sp.dow AS INT) AS dow, coalesce(CAST(bd.q AS DOUBLE), 0.0) / sp.k * coalesce(CAST(t.c AS DOUBLE) / nullif(CAST(t.p AS DOUBLE), 0.0), 1.0) AS portions
FROM sp LEFT JOIN bd ON bd.dow = sp.dow, t""")
def q_demand_forecast(b):
    return reports.demand_forecast(b.orders, b.order_lines, as_of="1998-08-01", days=30)


@register("daily_revenue_series", """
, r AS (SELECT CAST(created_at AS DATE) AS day, sum(total) AS revenue FROM orders_b
        WHERE status <> 'cancelled' AND CAST(created_at AS DATE) BETWEEN DATE '1998-08-02' - 6 AND DATE '1998-08-02' GROUP BY 1)
SELECT CAST(s.d AS DATE) AS day, CAST(coalesce(r.revenue, 0) AS DOUBLE) AS revenue
FROM (SELECT unnest(generate_series(DATE '1998-08-02' - 6, DATE '1998-08-02', INTERVAL 1 DAY)) AS d) s
LEFT JOIN r ON r.day = CAST(s.d AS DATE)""")
def q_daily_revenue_series(b):
    return reports.daily_revenue_series(b.orders, as_of="1998-08-02", days=7)


# --------------------------------------------------------------- delivery
@register("latest_position", """
SELECT p.order_id, CAST(p.latitude AS DOUBLE) AS latitude, CAST(p.longitude AS DOUBLE) AS longitude, p.recorded_at,
       p.shipper_id, s.full_name AS shipper_name, s.phone
FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY recorded_at DESC, event_id DESC) AS rn FROM pings) p
JOIN shippers s ON s.shipper_id = p.shipper_id WHERE p.rn = 1""")
def q_latest_position(b):
    return delivery.latest_position(b.pings, b.shippers)


@register("notification_feed", """
, c AS (SELECT n.user_id, n.notification_id, n.type, n.title, n.is_read, n.created_at FROM notifications n WHERE n.user_id IS NOT NULL
        UNION
        SELECT u.user_id, n.notification_id, n.type, n.title, n.is_read, n.created_at
        FROM users u JOIN notifications n ON n.target_role = u.role),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, notification_id DESC) AS INT) AS rank FROM c)
SELECT t.*, count(*) FILTER (WHERE NOT is_read) OVER (PARTITION BY user_id) AS unread FROM t WHERE rank <= 20
  QUALIFY true""")
def q_notification_feed(b):
    return delivery.notification_feed(b.notifications, b.users, k=20)
