"""Catalogue entries: menu, pricing, subscriptions, vouchers."""

from __future__ import annotations

from ..operators import menu, pricing, promo, stock, subs
from .catalog import register

WEEK = "1998-01-05"
SUBS_AS_OF = "2024-01-20"
STOCK_AS_OF = "2001-08-01"


# ------------------------------------------------------------------- menu
@register("products_listing", """
SELECT p.product_id, p.name, CAST(p.price AS DOUBLE) AS price, p.calories, c.name AS category
FROM products p LEFT JOIN categories c ON c.name = p.category
WHERE p.is_available AND c.slug = 'small' ORDER BY p.product_id LIMIT 100""")
def q_products_listing(b):
    return menu.products_listing(b.products, b.categories, available=True, category_slug="small", limit=100)


@register("menu_filter", """
SELECT product_id, name FROM products
WHERE (category = 'brand#1' OR list_bool_or(list_transform(from_json(health_tags, '["VARCHAR"]'), lambda x: contains(lower(x), 'brand#1'))))
  AND (contains(lower(name), 'red') OR contains(lower(coalesce(description, '')), 'red'))""")
def q_menu_filter(b):
    return menu.menu_filter(b.products, tag="brand#1", q=" RED ")


CHIP_MATCH = "(c.chip = 'all' OR c.chip = '' OR p.category = c.chip OR list_bool_or(list_transform(from_json(p.health_tags, '[\"VARCHAR\"]'), lambda x: contains(lower(x), c.chip))))"


@register("menu_chip_matches", f"""
, c AS (SELECT * FROM (VALUES ('all'), ('eat-clean'), ('keto'), ('low-carb'), ('high-protein'), ('giamcan')) t(chip))
SELECT c.chip, CAST(count(p.product_id) AS BIGINT) AS n FROM c LEFT JOIN products p ON {CHIP_MATCH} GROUP BY c.chip""")
def q_menu_chip_matches(b):
    return menu.menu_chip_matches(b.products)


@register("menu_sort", """
SELECT product_id, CAST(price AS DOUBLE) AS price, calories,
       row_number() OVER (ORDER BY price DESC, product_id ASC) AS pos FROM products""")
def q_menu_sort(b):
    return menu.menu_sort(b.products, "price_desc")


@register("menu_calendar", """
, s AS (SELECT m.meal_type, p.name, isodow(m.schedule_date) AS dow,
          row_number() OVER (PARTITION BY m.schedule_date, m.meal_type ORDER BY p.name, p.product_id) AS slot
        FROM menu_schedule m JOIN products p ON p.product_id = m.product_id
        WHERE m.schedule_date >= DATE '1998-01-05' AND m.schedule_date < DATE '1998-01-12')
SELECT meal_type, CAST(slot AS INT) AS slot,
  max(name) FILTER (WHERE dow = 1) AS mon, max(name) FILTER (WHERE dow = 2) AS tue,
  max(name) FILTER (WHERE dow = 3) AS wed, max(name) FILTER (WHERE dow = 4) AS thu,
  max(name) FILTER (WHERE dow = 5) AS fri, max(name) FILTER (WHERE dow = 6) AS sat,
  max(name) FILTER (WHERE dow = 7) AS sun
FROM s GROUP BY meal_type, slot""")
def q_menu_calendar(b):
    return menu.menu_calendar(b.menu_schedule, b.products, week_start=WEEK)


@register("menu_capacity", """
, sold AS (SELECT CAST(o.created_at AS DATE) AS schedule_date, oi.product_id, CAST(sum(oi.quantity) AS BIGINT) AS sold
           FROM order_items oi JOIN orders_b o ON o.order_id = oi.order_id WHERE o.status <> 'cancelled' GROUP BY 1, 2)
SELECT m.schedule_date, m.product_id, m.meal_type, m.max_quantity, coalesce(s.sold, 0) AS sold,
       greatest(m.max_quantity - coalesce(s.sold, 0), 0) AS remaining, coalesce(s.sold, 0) >= m.max_quantity AS sold_out
FROM menu_schedule m LEFT JOIN sold s ON s.schedule_date = m.schedule_date AND s.product_id = m.product_id""")
def q_menu_capacity(b):
    return menu.menu_capacity(b.menu_schedule, b.order_lines, b.orders)


ACTIVE_SUBS_SQL = """asub AS (SELECT * FROM subscriptions WHERE status = 'active' AND DATE '2024-01-20' BETWEEN start_date AND end_date)"""

SCHED_NEED_SQL = f"""{ACTIVE_SUBS_SQL},
cover AS (SELECT d.dow, mt.meal_type, sum(pp.subs) AS subscribers
          FROM (SELECT plan_id, count(*) AS subs FROM asub GROUP BY plan_id) pp
          JOIN plans pl ON pl.plan_id = pp.plan_id
          JOIN (VALUES (1, 'lunch'), (2, 'lunch'), (2, 'dinner'), (3, 'breakfast'), (3, 'lunch'), (3, 'dinner')) mt(mpd, meal_type)
            ON mt.mpd = pl.meals_per_day
          JOIN (SELECT range AS dow FROM range(1, 8)) d ON d.dow <= pl.days_per_week
          GROUP BY 1, 2),
wk AS (SELECT m.*, isodow(m.schedule_date) AS dow FROM menu_schedule m
       WHERE m.schedule_date >= DATE '1998-01-05' AND m.schedule_date < DATE '1998-01-12'),
pp AS (SELECT wk.product_id, sum(wk.max_quantity + coalesce(c.subscribers, 0)) AS portions
       FROM wk LEFT JOIN cover c ON c.dow = wk.dow AND c.meal_type = wk.meal_type GROUP BY wk.product_id),
wneed AS (SELECT pi.inventory_id, sum(pp.portions * pi.qty_per_portion) AS need
          FROM pp JOIN product_ingredients pi ON pi.product_id = pp.product_id GROUP BY pi.inventory_id)"""


def _active_subs(b):
    return subs.active_subscriptions_as_of(b.subscriptions, as_of=SUBS_AS_OF)


def _week_need(b):
    return menu.ingredient_need_from_schedule(b.menu_schedule, _active_subs(b), b.plans,
                                              b.product_ingredients, week_start=WEEK)


@register("ingredient_need_from_schedule", f", {SCHED_NEED_SQL} SELECT inventory_id, CAST(need AS DOUBLE) AS need FROM wneed")
def q_ingredient_need_from_schedule(b):
    return _week_need(b)


@register("menu_week_stats", f"""
, {SCHED_NEED_SQL},
short AS (SELECT greatest(n.need - i.quantity, 0) AS shortfall FROM wneed n JOIN inventory i ON i.inventory_id = n.inventory_id)
SELECT (SELECT CAST(sum(max_quantity) AS BIGINT) FROM wk) AS servings,
       (SELECT count(*) FROM asub) AS active_subs,
       (SELECT CAST(sum(shortfall) AS DOUBLE) FROM short) AS buy_qty,
       (SELECT CAST(sum(wk.max_quantity * p.price) AS DOUBLE) FROM wk JOIN products p ON p.product_id = wk.product_id) AS revenue""")
def q_menu_week_stats(b):
    plan = stock.ingredient_plan(_week_need(b), b.inventory)
    return menu.menu_week_stats(b.menu_schedule, b.products, _active_subs(b), plan, week_start=WEEK)


# ---------------------------------------------------------------- pricing
def voucher_sql(req: str, as_of: str = "2001-08-01") -> str:
    return f"""vj AS (SELECT r.*, v.voucher_id, v.discount_type, v.discount_value, v.max_discount, v.min_order,
          v.max_uses, v.used_count,
          coalesce(v.voucher_id IS NOT NULL AND v.is_active AND (v.expires_at IS NULL OR v.expires_at > DATE '{as_of}')
                   AND (v.max_uses IS NULL OR v.used_count < v.max_uses) AND r.subtotal >= v.min_order, false) AS valid
        FROM {req} r LEFT JOIN vouchers v ON upper(trim(r.voucher_code)) = v.code),
vrk AS (SELECT *, row_number() OVER (PARTITION BY voucher_id ORDER BY created_at, order_id) AS rnk FROM vj WHERE valid),
vacc AS (SELECT order_id, voucher_id AS applied_voucher_id,
           CAST(CASE WHEN discount_type = 'percent' THEN
                  CASE WHEN max_discount IS NULL THEN subtotal * discount_value * CAST(0.01 AS DECIMAL(3,2))
                       ELSE least(subtotal * discount_value * CAST(0.01 AS DECIMAL(3,2)), max_discount) END
                ELSE discount_value END AS DECIMAL(10,0)) AS discount
         FROM vrk WHERE max_uses IS NULL OR rnk <= max_uses - used_count),
vres AS (SELECT vj.order_id, vj.voucher_code, vacc.applied_voucher_id,
           coalesce(vacc.discount, 0) AS discount, vj.subtotal - coalesce(vacc.discount, 0) AS total,
           vj.user_id, vj.subtotal, vj.created_at
         FROM vj LEFT JOIN vacc ON vacc.order_id = vj.order_id)"""


@register("apply_voucher", f"""
, {voucher_sql('voucher_requests')}
SELECT order_id, voucher_code, applied_voucher_id, CAST(discount AS DOUBLE) AS discount, CAST(total AS DOUBLE) AS total,
       user_id, CAST(subtotal AS DOUBLE) AS subtotal, created_at FROM vres""")
def q_apply_voucher(b):
    return pricing.apply_voucher(b.voucher_requests, b.vouchers, as_of=STOCK_AS_OF)


CREATE_SQL = f"""parsed AS (SELECT * FROM (SELECT order_id, line_no, unnest(from_json(items_json,
  '[{{"product_id":"BIGINT","qty":"INTEGER","notes":"VARCHAR"}}]'), recursive := true) FROM order_request_items) x
  WHERE product_id IS NOT NULL),
pr AS (SELECT it.*, p.price, CAST(p.price * it.qty AS DECIMAL(18,2)) AS s, p.calories
       FROM parsed it JOIN products p ON p.product_id = it.product_id),
sub AS (SELECT order_id, sum(s) AS subtotal FROM pr GROUP BY order_id),
asked AS (SELECT q.order_id, q.user_id, q.created_at, q.voucher_code, q.order_type, q.payment_method, q.delivery_timeslot,
                 sub.subtotal FROM order_requests q LEFT JOIN sub ON sub.order_id = q.order_id),
req AS (SELECT * FROM asked WHERE subtotal IS NOT NULL),
{voucher_sql('req')},
made AS (SELECT v.*, 'FF-' || CAST(v.order_id AS VARCHAR) AS order_code, q.order_type, q.payment_method, q.delivery_timeslot
         FROM vres v JOIN req q ON q.order_id = v.order_id),
pts AS (SELECT * FROM (SELECT user_id, order_id, CAST(floor((subtotal - discount) / 10000) AS BIGINT) AS points
                       FROM vres WHERE user_id IS NOT NULL) t WHERE points > 0)"""


def _created(b, frame: str):
    return pricing.create_orders(b.order_requests, b.order_request_items, b.products, b.vouchers, as_of=STOCK_AS_OF)[frame]


@register("create_orders", f"""
, {CREATE_SQL}
SELECT order_id, order_code, user_id, voucher_code, CAST(subtotal AS DOUBLE) AS subtotal,
       CAST(discount AS DOUBLE) AS discount_amount, CAST(total AS DOUBLE) AS total, 'pending' AS status, created_at,
       order_type, payment_method, delivery_timeslot FROM made""")
def q_create_orders(b):
    return _created(b, "orders")


@register("create_orders_items", f"""
, {CREATE_SQL}
SELECT order_id, line_no, product_id, qty, notes, CAST(price AS DOUBLE) AS unit_price, CAST(s AS DOUBLE) AS line_subtotal,
       calories AS calories_snapshot FROM pr""")
def q_create_orders_items(b):
    return _created(b, "order_items").drop("protein_snapshot", "carbs_snapshot", "fat_snapshot")


@register("create_orders_usages", f"""
, {CREATE_SQL}
SELECT applied_voucher_id AS voucher_id, order_id, user_id, CAST(discount AS DOUBLE) AS discount_amount, created_at AS used_at
FROM vres WHERE applied_voucher_id IS NOT NULL""")
def q_create_orders_usages(b):
    return _created(b, "voucher_usages")


@register("create_orders_voucher_counts", f"""
, {CREATE_SQL}
SELECT v.voucher_id, v.code, v.used_count + coalesce(u.n, 0) AS used_count
FROM vouchers v LEFT JOIN (SELECT applied_voucher_id, count(*) AS n FROM vres WHERE applied_voucher_id IS NOT NULL GROUP BY 1) u
  ON u.applied_voucher_id = v.voucher_id""")
def q_create_orders_voucher_counts(b):
    return _created(b, "voucher_counts")


@register("create_orders_loyalty", f"""
, {CREATE_SQL} SELECT user_id, order_id, points, 'order' AS reason FROM pts""")
def q_create_orders_loyalty(b):
    return _created(b, "loyalty_transactions")


@register("create_orders_points", f"""
, {CREATE_SQL} SELECT user_id, CAST(sum(points) AS BIGINT) AS points FROM pts GROUP BY user_id""")
def q_create_orders_points(b):
    return _created(b, "loyalty_points")


@register("create_orders_notifications", f"""
, {CREATE_SQL}
SELECT order_id, 'kitchen' AS target_role, 'new_order' AS type, 'Đơn hàng mới' AS title,
       'Đơn ' || order_code || ' cần chế biến: ' || CAST(CAST(subtotal AS DECIMAL(28,2)) AS VARCHAR) AS message FROM made""")
def q_create_orders_notifications(b):
    return _created(b, "notifications")


@register("create_orders_rejects", f"""
, {CREATE_SQL}
SELECT order_id, user_id, 'no item matches a product' AS reason FROM asked WHERE subtotal IS NULL""")
def q_create_orders_rejects(b):
    return _created(b, "rejects")


@register("create_orders_all", f"""
, {CREATE_SQL},
used AS (SELECT v.voucher_id, v.used_count + coalesce(u.n, 0) AS used_count
  FROM vouchers v LEFT JOIN (SELECT applied_voucher_id, count(*) AS n FROM vres WHERE applied_voucher_id IS NOT NULL GROUP BY 1) u
    ON u.applied_voucher_id = v.voucher_id)
SELECT 'orders' AS frame, count(*) AS n_rows, CAST(sum(total) AS DOUBLE) AS amount FROM made
UNION ALL SELECT 'order_items', count(*), CAST(sum(s) AS DOUBLE) FROM pr
UNION ALL SELECT 'voucher_usages', count(*), CAST(sum(discount) AS DOUBLE) FROM vres WHERE applied_voucher_id IS NOT NULL
UNION ALL SELECT 'voucher_counts', count(*), CAST(sum(used_count) AS DOUBLE) FROM used
UNION ALL SELECT 'loyalty_transactions', count(*), CAST(sum(points) AS DOUBLE) FROM pts
UNION ALL SELECT 'loyalty_points', count(DISTINCT user_id), CAST(sum(points) AS DOUBLE) FROM pts
UNION ALL SELECT 'notifications', count(*), CAST(sum(order_id) AS DOUBLE) FROM made
UNION ALL SELECT 'rejects', count(*), CAST(sum(order_id) AS DOUBLE) FROM asked WHERE subtotal IS NULL""")
def q_create_orders_all(b):
    """All eight frames of a batch in one commit, each counted and summed from the stored table."""
    import uuid

    from pyspark.sql import functions as F

    from ..session import checkpoint_dir
    from ..sources.versions import VersionedTables
    store = VersionedTables(b.spark, f"{checkpoint_dir(b.spark).rstrip('/')}/placed-{uuid.uuid4().hex[:12]}")
    pricing.place_orders(store, b.order_requests, b.order_request_items, b.products, b.vouchers, as_of=STOCK_AS_OF,
                         batch_id="batch-1")
    amounts = {"orders": "total", "order_items": "line_subtotal", "voucher_usages": "discount_amount",
               "voucher_counts": "used_count", "loyalty_transactions": "points", "loyalty_points": "points",
               "notifications": "order_id", "rejects": "order_id"}
    parts = [store.read(name).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(c).cast("double").alias("amount"))
             .select(F.lit(name).alias("frame"), "n_rows", "amount") for name, c in amounts.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


ACCRUAL_SQL = """acc AS (SELECT * FROM (SELECT user_id, order_id,
    CAST(floor((subtotal - discount_amount) / 10000) AS BIGINT) AS points FROM orders_b WHERE user_id IS NOT NULL) t
  WHERE points > 0)"""


@register("loyalty_accrual", f", {ACCRUAL_SQL} SELECT * FROM acc")
def q_loyalty_accrual(b):
    return pricing.loyalty_accrual(b.orders)


@register("loyalty_balance", f", {ACCRUAL_SQL} SELECT user_id, CAST(sum(points) AS BIGINT) AS points, CAST(sum(points) AS BIGINT) * 1000 AS value_vnd FROM acc GROUP BY user_id")
def q_loyalty_balance(b):
    return pricing.loyalty_balance(pricing.loyalty_accrual(b.orders))


# ---------------------------------------------------------- subscriptions
@register("active_plans", "SELECT plan_id, name FROM plans WHERE is_active")
def q_active_plans(b):
    return subs.active_plans(b.plans)


@register("active_subscriptions_as_of", f", {ACTIVE_SUBS_SQL} SELECT subscription_id, user_id, plan_id FROM asub")
def q_active_subscriptions_as_of(b):
    return _active_subs(b).select("subscription_id", "user_id", "plan_id")


@register("active_subscription_per_user", """
SELECT s.user_id, s.subscription_id, p.name AS plan_name FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, subscription_id DESC) AS rn
  FROM subscriptions WHERE status = 'active') s JOIN plans p ON p.plan_id = s.plan_id WHERE rn = 1""")
def q_active_subscription_per_user(b):
    return subs.active_subscription_per_user(b.subscriptions, b.plans)


@register("subscription_report", """
, g AS (SELECT plan_id,
          count(*) FILTER (WHERE status = 'active' AND start_date < DATE '2024-02-01' AND end_date >= DATE '2024-01-01') AS active,
          count(*) FILTER (WHERE start_date >= DATE '2024-01-01' AND start_date < DATE '2024-02-01') AS new,
          count(*) FILTER (WHERE start_date >= DATE '2024-01-01' AND start_date < DATE '2024-02-01' AND status = 'cancelled') AS cancelled
        FROM subscriptions GROUP BY plan_id)
SELECT g.plan_id, g.active, g.new, g.cancelled,
       CASE WHEN g.active = 0 THEN NULL ELSE (g.active - g.cancelled) * 100.0 / CAST(g.active AS DOUBLE) END AS retention,
       CAST(g.active * p.price_weekly AS DOUBLE) AS revenue
FROM g JOIN plans p ON p.plan_id = g.plan_id""")
def q_subscription_report(b):
    return subs.subscription_report(b.subscriptions, b.plans, month="2024-01")


@register("subscribe_batch", """
, r AS (SELECT q.*, coalesce(CASE q.plan WHEN 'basic' THEN 1 WHEN 'standard' THEN 2 WHEN 'premium' THEN 3 END, 1) AS plan_id
        FROM subscribe_requests q),
lst AS (SELECT user_id, request_id AS last_id FROM (
          SELECT user_id, request_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, request_id DESC) AS rn
          FROM subscribe_requests) t WHERE rn = 1)
SELECT s.subscription_id, s.user_id, s.plan_id, s.start_date, s.end_date,
       CASE WHEN l.user_id IS NOT NULL AND s.status = 'active' THEN 'cancelled' ELSE s.status END AS status,
       s.period, CAST(NULL AS DOUBLE) AS price, s.created_at
FROM subscriptions s LEFT JOIN lst l ON l.user_id = s.user_id
UNION ALL
SELECT r.request_id, r.user_id, r.plan_id, CAST(r.ts AS DATE), CAST(r.ts AS DATE) + CASE WHEN r.period = 'weekly' THEN 7 ELSE 30 END,
       CASE WHEN r.request_id = l.last_id THEN 'active' ELSE 'cancelled' END, r.period,
       CAST(CASE WHEN r.period = 'weekly' THEN p.price_weekly ELSE p.price_monthly END AS DOUBLE), r.ts
FROM r JOIN plans p ON p.plan_id = r.plan_id JOIN lst l ON l.user_id = r.user_id""")
def q_subscribe_batch(b):
    return subs.subscribe_batch(b.subscriptions, b.subscribe_requests, b.plans)


@register("subscription_lifecycle", """
, m AS (SELECT ev.event_id, ev.ts, ev.action, s.subscription_id
        FROM lifecycle_events ev ASOF JOIN subscriptions s ON ev.user_id = s.user_id AND ev.ts >= s.created_at),
l AS (SELECT subscription_id, CASE action WHEN 'pause' THEN 'paused' WHEN 'renew' THEN 'active' ELSE 'cancelled' END AS new_status,
        row_number() OVER (PARTITION BY subscription_id ORDER BY ts DESC, event_id DESC) AS rn FROM m)
SELECT s.subscription_id, s.user_id, s.plan_id, s.start_date, s.end_date,
       CASE WHEN coalesce(l.new_status, s.status) = 'active' AND s.end_date < DATE '2024-01-30' THEN 'expired'
            ELSE coalesce(l.new_status, s.status) END AS status
FROM subscriptions s LEFT JOIN l ON l.subscription_id = s.subscription_id AND l.rn = 1""")
def q_subscription_lifecycle(b):
    return subs.subscription_lifecycle(b.subscriptions, b.lifecycle_events, as_of="2024-01-30")


# --------------------------------------------------------------- vouchers
USABLE_SQL = "is_active AND (expires_at IS NULL OR expires_at > DATE '2001-08-01') AND (max_uses IS NULL OR used_count < max_uses)"


@register("usable_vouchers", f"SELECT voucher_id, code FROM vouchers WHERE {USABLE_SQL}")
def q_usable_vouchers(b):
    return pricing.usable_vouchers(b.vouchers, as_of=STOCK_AS_OF)


@register("voucher_usage_rate", """
SELECT voucher_id, code, CAST(used_count AS DOUBLE) / nullif(CAST(max_uses AS DOUBLE), 0) AS rate,
       coalesce(CAST(used_count AS DOUBLE) / nullif(CAST(max_uses AS DOUBLE), 0) > 0.8, false) AS hot,
       coalesce(expires_at < DATE '2001-08-01', false) AS expired FROM vouchers""")
def q_voucher_usage_rate(b):
    return promo.voucher_usage_rate(b.vouchers, as_of=STOCK_AS_OF)


@register("voucher_stats", f"""
SELECT (SELECT count(*) FILTER (WHERE {USABLE_SQL}) FROM vouchers) AS active_vouchers,
       (SELECT count(*) FROM voucher_usages WHERE used_at >= TIMESTAMP '1998-07-01' AND used_at < TIMESTAMP '1998-08-01') AS uses_in_month,
       (SELECT CAST(sum(discount_amount) AS DOUBLE) FROM voucher_usages WHERE used_at >= TIMESTAMP '1998-07-01' AND used_at < TIMESTAMP '1998-08-01') AS discount_given""")
def q_voucher_stats(b):
    return promo.voucher_stats(b.vouchers, b.voucher_usages, as_of=STOCK_AS_OF, month="1998-07")


@register("voucher_redemption_rollup", """
SELECT v.voucher_id, v.code, coalesce(c.used, 0) AS used FROM vouchers v
LEFT JOIN (SELECT voucher_id, count(*) AS used FROM voucher_usages GROUP BY voucher_id) c ON c.voucher_id = v.voucher_id""")
def q_voucher_redemption_rollup(b):
    return promo.voucher_redemption_rollup(b.vouchers, b.voucher_usages)


@register("voucher_eligibility", f"""
, {ACTIVE_SUBS_SQL},
cust AS (SELECT user_id FROM users WHERE role = 'customer'),
fresh AS (SELECT user_id FROM cust WHERE user_id NOT IN (SELECT user_id FROM orders_b WHERE status <> 'cancelled'
            AND created_at < TIMESTAMP '2001-08-01' AND user_id IS NOT NULL)),
tags AS (SELECT user_id, 'new_user' AS cond FROM fresh UNION ALL SELECT user_id, 'first_order' FROM fresh
         UNION ALL SELECT user_id, 'subscription' FROM cust WHERE user_id IN (SELECT user_id FROM asub))
SELECT t.user_id, v.voucher_id, 'own' AS scope FROM tags t JOIN vouchers v ON v.condition_type = t.cond
WHERE {USABLE_SQL.replace('is_active', 'v.is_active')}
UNION ALL SELECT NULL, voucher_id, 'all' FROM vouchers WHERE condition_type = 'all' AND {USABLE_SQL}""")
def q_voucher_eligibility(b):
    return promo.voucher_eligibility(b.users, b.orders, _active_subs(b), b.vouchers, as_of=STOCK_AS_OF)


@register("vouchers_of_customers", f"""
, {ACTIVE_SUBS_SQL},
cust AS (SELECT user_id FROM users WHERE role = 'customer'),
fresh AS (SELECT user_id FROM cust WHERE user_id NOT IN (SELECT user_id FROM orders_b WHERE status <> 'cancelled'
            AND created_at < TIMESTAMP '2001-08-01' AND user_id IS NOT NULL)),
tags AS (SELECT user_id, 'all' AS cond FROM cust UNION ALL SELECT user_id, 'new_user' FROM fresh
         UNION ALL SELECT user_id, 'first_order' FROM fresh
         UNION ALL SELECT user_id, 'subscription' FROM cust WHERE user_id IN (SELECT user_id FROM asub))
SELECT t.user_id, v.voucher_id FROM tags t JOIN vouchers v ON v.condition_type = t.cond
WHERE t.user_id % 50 = 3 AND {USABLE_SQL.replace('is_active', 'v.is_active')}""")
def q_vouchers_of_customers(b):
    """Bitmaps over all customers; the pairs of every fiftieth customer are asked for."""
    bitmaps = promo.condition_bitmaps(b.users, b.orders, _active_subs(b), as_of=STOCK_AS_OF)
    asked = b.users.filter("user_id % 50 = 3").select("user_id")
    return promo.vouchers_of(asked, bitmaps, b.vouchers, as_of=STOCK_AS_OF)
