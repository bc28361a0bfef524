"""Catalogue entries: reports, orders, menu, stock, customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports
from .catalog import register


@register("revenue_report", """
SELECT CAST(created_at AS DATE) AS report_date, count(*) AS total_orders,
       CAST(sum(total) AS DOUBLE) AS total_revenue,
       CAST(sum(discount_amount) AS DOUBLE) AS total_discount,
       CAST(sum(total) AS DOUBLE) / count(*) AS avg_order_value,
       count(*) FILTER (WHERE order_type = 'online') AS online_orders,
       count(*) FILTER (WHERE order_type = 'walkin') AS walkin_orders
FROM orders_b
WHERE CAST(created_at AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1998-03-31' AND status <> 'cancelled'
GROUP BY 1""")
def q_revenue_report(b):
    return reports.revenue_report(b.orders, date_from="1998-01-01", date_to="1998-03-31")


# ----------------------------------------------------------------- orders
from ..operators import orders as ord_ops  # noqa: E402
from ..sources import parse  # noqa: E402

PARSED_SQL = """parsed AS (SELECT * FROM (SELECT order_id, line_no, unnest(from_json(items_json,
  '[{"product_id":"BIGINT","qty":"INTEGER","notes":"VARCHAR"}]'), recursive := true) FROM requests) x
  WHERE product_id IS NOT NULL)"""


@register("parse_order_items", f", {PARSED_SQL} SELECT order_id, line_no, product_id, qty, notes FROM parsed")
def q_parse_order_items(b):
    return parse.parse_order_items(b.requests)


@register("parse_health_tags", """
SELECT product_id, unnest(from_json(health_tags, '["VARCHAR"]')) AS tag FROM products""")
def q_parse_health_tags(b):
    return parse.parse_health_tags(b.products)


@register("orders_listing", """
, t AS (SELECT * FROM orders_b WHERE status IN ('pending', 'preparing') AND order_type = 'online'
        ORDER BY created_at DESC, order_id DESC LIMIT 200)
SELECT t.order_id, t.status, t.order_type, CAST(t.subtotal AS DOUBLE) AS subtotal,
       CAST(t.total AS DOUBLE) AS total, t.created_at, u.full_name AS customer_name
FROM t LEFT JOIN users u ON u.user_id = t.user_id""")
def q_orders_listing(b):
    return ord_ops.orders_listing(b.orders, b.users, role="admin", statuses=" pending, preparing,, ",
                                  order_type="online", limit="500")


@register("orders_listing_customer", """
, t AS (SELECT * FROM orders_b WHERE user_id = (SELECT min(user_id) FROM orders_b) ORDER BY created_at DESC, order_id DESC LIMIT 50)
SELECT t.order_id, t.status, t.order_type, CAST(t.subtotal AS DOUBLE) AS subtotal,
       CAST(t.total AS DOUBLE) AS total, t.created_at, u.full_name AS customer_name
FROM t LEFT JOIN users u ON u.user_id = t.user_id""")
def q_orders_listing_customer(b):
    """A customer sees only their own orders (here the customer with the smallest id)."""
    me = b.orders.agg(F.min("user_id")).scalar()
    return ord_ops.orders_listing(b.orders, b.users, role="customer", user_id=me)


@register("row_scope_by_role", """
SELECT user_id AS viewer_id, role, CAST(NULL AS BIGINT) AS order_id, 'all' AS scope
FROM users WHERE role IN ('admin', 'kitchen')
UNION ALL
SELECT u.user_id, u.role, o.order_id, 'own' FROM users u JOIN orders_b o ON o.user_id = u.user_id
WHERE u.role NOT IN ('admin', 'kitchen')""")
def q_row_scope_by_role(b):
    return ord_ops.row_scope_by_role(b.orders, b.users)


@register("my_orders", """
, ic AS (SELECT order_id, count(*) AS item_count FROM order_items GROUP BY order_id)
SELECT o.user_id, o.order_id, o.status, CAST(o.total AS DOUBLE) AS total,
       coalesce(ic.item_count, 0) AS item_count, o.created_at
FROM orders_b o LEFT JOIN ic ON ic.order_id = o.order_id WHERE o.user_id IS NOT NULL""")
def q_my_orders(b):
    return ord_ops.my_orders(b.orders, b.order_lines)


@register("orders_by_status", "SELECT order_id, status FROM orders_b WHERE status = 'preparing'")
def q_orders_by_status(b):
    return ord_ops.orders_by_status(b.orders, "preparing")


@register("current_delivering_order", """
SELECT user_id, order_id FROM (
  SELECT user_id, order_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, order_id DESC) AS rn
  FROM orders_b WHERE status = 'pending' AND user_id IS NOT NULL) t WHERE rn = 1""")
def q_current_delivering_order(b):
    # The bound data has no 'delivering' orders; the same rule runs on 'pending'.
    return ord_ops.current_delivering_order(b.orders, status="pending")


@register("order_summary", """
, ic AS (SELECT order_id, count(*) AS item_count,
                CAST(sum(CAST(quantity AS BIGINT) * calories_snapshot) AS BIGINT) AS total_calories
         FROM order_items GROUP BY order_id)
SELECT o.order_id, u.full_name AS customer_name, CAST(o.total AS DOUBLE) AS total,
       coalesce(ic.item_count, 0) AS item_count, ic.total_calories
FROM orders_b o LEFT JOIN ic ON ic.order_id = o.order_id LEFT JOIN users u ON u.user_id = o.user_id""")
def q_order_summary(b):
    return ord_ops.order_summary(b.orders, b.users, b.order_items)


@register("price_order_items", f"""
, {PARSED_SQL}
SELECT it.order_id, it.line_no, it.product_id, it.qty, it.notes, CAST(p.price AS DOUBLE) AS unit_price,
       CAST(CAST(p.price * it.qty AS DECIMAL(18,2)) AS DOUBLE) AS line_subtotal,
       p.calories AS calories_snapshot, CAST(p.protein_g AS DOUBLE) AS protein_snapshot,
       CAST(p.carbs_g AS DOUBLE) AS carbs_snapshot, CAST(p.fat_g AS DOUBLE) AS fat_snapshot
FROM parsed it JOIN products p ON p.product_id = it.product_id""")
def q_price_order_items(b):
    return ord_ops.price_order_items(parse.parse_order_items(b.requests), b.products)


@register("order_subtotal", f"""
, {PARSED_SQL},
pr AS (SELECT it.order_id, CAST(p.price * it.qty AS DECIMAL(18,2)) AS s FROM parsed it JOIN products p ON p.product_id = it.product_id)
SELECT r.order_id, CAST(sum(pr.s) AS DOUBLE) AS subtotal
FROM (SELECT DISTINCT order_id FROM requests) r LEFT JOIN pr ON pr.order_id = r.order_id GROUP BY r.order_id""")
def q_order_subtotal(b):
    priced = ord_ops.price_order_items(parse.parse_order_items(b.requests), b.products)
    return ord_ops.order_subtotal(b.requests, priced)


TRANSITIONS_SQL = """tr AS (SELECT order_id, event_id, ts FROM (
  SELECT *, lag(status) OVER (PARTITION BY order_id ORDER BY ts, event_id) AS prev_status FROM status_events) t
  WHERE status = 'preparing' AND prev_status IS NOT NULL AND prev_status <> 'preparing')"""


@register("status_transitions", f", {TRANSITIONS_SQL} SELECT * FROM tr")
def q_status_transitions(b):
    return ord_ops.status_transitions(b.status_events, "preparing")


@register("preparing_exists", f", {TRANSITIONS_SQL} SELECT order_id, status FROM orders_b o WHERE EXISTS (SELECT 1 FROM tr WHERE tr.order_id = o.order_id)")
def q_preparing_exists(b):
    return ord_ops.preparing_exists(b.orders, ord_ops.status_transitions(b.status_events, "preparing"))


@register("status_durations", """
, f AS (SELECT order_id,
          min(ts) FILTER (WHERE status = 'pending') AS t_pending,
          min(ts) FILTER (WHERE status = 'confirmed') AS t_confirmed,
          min(ts) FILTER (WHERE status = 'preparing') AS t_preparing,
          min(ts) FILTER (WHERE status = 'ready') AS t_ready,
          min(ts) FILTER (WHERE status = 'done') AS t_done
        FROM status_events GROUP BY order_id),
s AS (
  SELECT order_id, 'pending->confirmed' AS step, CAST(epoch_us(t_confirmed) - epoch_us(t_pending) AS DOUBLE) / 60000000.0 AS minutes FROM f
  UNION ALL SELECT order_id, 'confirmed->preparing', CAST(epoch_us(t_preparing) - epoch_us(t_confirmed) AS DOUBLE) / 60000000.0 FROM f
  UNION ALL SELECT order_id, 'preparing->ready', CAST(epoch_us(t_ready) - epoch_us(t_preparing) AS DOUBLE) / 60000000.0 FROM f
  UNION ALL SELECT order_id, 'ready->done', CAST(epoch_us(t_done) - epoch_us(t_ready) AS DOUBLE) / 60000000.0 FROM f)
SELECT * FROM s WHERE minutes IS NOT NULL""")
def q_status_durations(b):
    return ord_ops.status_durations(b.status_events)


RANK_SQL = "CASE {c} WHEN 'pending' THEN 1 WHEN 'confirmed' THEN 2 WHEN 'preparing' THEN 3 WHEN 'ready' THEN 4 WHEN 'delivering' THEN 5 WHEN 'done' THEN 6 WHEN 'cancelled' THEN 7 END"


DURATION_DAYS = {"date_from": "2024-01-03", "date_to": "2024-01-20"}


@register("status_duration_percentiles", """
, firsts AS (SELECT order_id, min(ts) FILTER (WHERE status = 'pending') AS t0, min(ts) FILTER (WHERE status = 'confirmed') AS t1,
               min(ts) FILTER (WHERE status = 'preparing') AS t2, min(ts) FILTER (WHERE status = 'ready') AS t3,
               min(ts) FILTER (WHERE status = 'done') AS t4 FROM status_events GROUP BY order_id),
steps AS (SELECT 'pending->confirmed' AS step, t0 AS a, t1 AS b FROM firsts UNION ALL SELECT 'confirmed->preparing', t1, t2 FROM firsts
          UNION ALL SELECT 'preparing->ready', t2, t3 FROM firsts UNION ALL SELECT 'ready->done', t3, t4 FROM firsts)
SELECT step, p, count(*) AS n, true AS within FROM steps, (SELECT unnest([0.5::DOUBLE, 0.9::DOUBLE, 0.99::DOUBLE]) AS p)
WHERE a IS NOT NULL AND b IS NOT NULL AND CAST(a AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-20' GROUP BY step, p""")
def q_status_duration_percentiles(b):
    """Percentiles of a range of days from daily sketches, each with its rank checked against all exact minutes."""
    steps = ord_ops.stage_steps(b.status_events)
    found = ord_ops.duration_percentiles(ord_ops.duration_sketches(steps), **DURATION_DAYS)
    return ord_ops.rank_checked(found, steps, error=0.02, **DURATION_DAYS)


@register("status_history_check", f"""
, e AS (SELECT *, lag(status) OVER (PARTITION BY order_id ORDER BY ts, event_id) AS prev_status FROM status_events),
c AS (SELECT order_id, event_id, prev_status AS from_status, status AS to_status,
        CASE WHEN prev_status = 'cancelled' THEN 'after_cancel'
             WHEN status = 'cancelled' THEN NULL
             WHEN {RANK_SQL.format(c='status')} < {RANK_SQL.format(c='prev_status')} THEN 'backward'
             WHEN {RANK_SQL.format(c='status')} > {RANK_SQL.format(c='prev_status')} + 1 THEN 'skipped' END AS problem
      FROM e WHERE prev_status IS NOT NULL)
SELECT * FROM c WHERE problem IS NOT NULL""")
def q_status_history_check(b):
    return ord_ops.status_history_check(b.status_events)


@register("order_notifications", """
SELECT order_id, 'kitchen' AS target_role, 'new_order' AS type, 'Đơn hàng mới' AS title,
       'Đơn ' || order_code || ' cần chế biến: ' || CAST(subtotal AS VARCHAR) AS message
FROM orders_b""")
def q_order_notifications(b):
    return ord_ops.order_notifications(b.orders)


@register("order_progress", """
SELECT order_id, status, step, greatest(step - 1, 0) AS stages_done FROM (
  SELECT order_id, status, CASE status WHEN 'pending' THEN 1 WHEN 'confirmed' THEN 2 WHEN 'preparing' THEN 3
    WHEN 'ready' THEN 3 WHEN 'delivering' THEN 4 WHEN 'done' THEN 5 ELSE 0 END AS step FROM orders_b) t""")
def q_order_progress(b):
    return ord_ops.order_progress(b.orders)


@register("kitchen_ticket_priority", """
, l AS (SELECT order_id, status, ts, row_number() OVER (PARTITION BY order_id ORDER BY ts DESC, event_id DESC) AS rn
        FROM status_events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00'),
p AS (SELECT order_id, ts AS arrived_at,
        CAST(floor((epoch_us(TIMESTAMP '2024-01-15 12:00:00') - epoch_us(ts)) / 60000000) AS BIGINT) AS elapsed_min
      FROM l WHERE rn = 1 AND status = 'pending')
SELECT order_id, arrived_at, elapsed_min,
       CASE WHEN elapsed_min >= 20 THEN 'high' WHEN elapsed_min >= 12 THEN 'medium' ELSE 'normal' END AS priority,
       elapsed_min >= 15 AS urgent FROM p""")
def q_kitchen_ticket_priority(b):
    return ord_ops.kitchen_ticket_priority(b.status_events, as_of="2024-01-15 12:00:00")


@register("kitchen_backlog", """
SELECT 'pending' AS status, count(*) FILTER (WHERE status = 'pending') AS n FROM orders_b
UNION ALL SELECT 'preparing', count(*) FILTER (WHERE status = 'preparing') FROM orders_b""")
def q_kitchen_backlog(b):
    return ord_ops.kitchen_backlog(b.orders)


@register("label_rows", """
SELECT '#' || CAST(oi.order_id AS VARCHAR) || '-' || CASE WHEN nn < 10 THEN '0' ELSE '' END || CAST(nn AS VARCHAR) AS label_id,
       oi.order_id, p.name, oi.quantity, oi.calories_snapshot AS kcal,
       CAST(oi.protein_snapshot AS DOUBLE) AS protein_g, CAST(oi.carbs_snapshot AS DOUBLE) AS carbs_g,
       CAST(oi.fat_snapshot AS DOUBLE) AS fat_g
FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY line_no, product_id, quantity, subtotal) AS nn
      FROM order_items) oi LEFT JOIN products p ON p.product_id = oi.product_id""")
def q_label_rows(b):
    return ord_ops.label_rows(b.orders, b.order_items, b.products)


# ------------------------------------------------------------------ stock
from ..operators import stock  # noqa: E402

AS_OF = "2001-08-01"

INV_STATUS_SQL = """ist AS (SELECT i.*, s.name AS supplier_name,
    CAST(datediff('day', DATE '2001-08-01', i.expiry_date) AS INT) AS days_until_expiry,
    CASE WHEN datediff('day', DATE '2001-08-01', i.expiry_date) <= 1 THEN 'critical'
         WHEN datediff('day', DATE '2001-08-01', i.expiry_date) <= 3 THEN 'warning' ELSE 'ok' END AS expiry_status,
    CASE WHEN i.quantity <= 0 THEN 'out_of_stock' WHEN i.quantity <= i.min_quantity THEN 'low_stock'
         ELSE 'in_stock' END AS stock_status
  FROM inventory i LEFT JOIN suppliers s ON s.supplier_id = i.supplier_id)"""


def _inv_status(b):
    return stock.inventory_status(b.inventory, b.suppliers, as_of=AS_OF)


@register("inventory_by_category", """
SELECT inventory_id, name FROM inventory WHERE category = (SELECT min(category) FROM inventory)""")
def q_inventory_by_category(b):
    # The first category in name order, as a scalar subquery.
    return stock.inventory_by_category(b.inventory, b.inventory.agg(F.min("category")).scalar())


@register("inventory_status", f"""
, {INV_STATUS_SQL}
SELECT inventory_id, name, supplier_name, CAST(quantity AS DOUBLE) AS quantity, days_until_expiry,
       expiry_status, stock_status FROM ist""")
def q_inventory_status(b):
    return _inv_status(b).select("inventory_id", "name", "supplier_name", "quantity",
                                 "days_until_expiry", "expiry_status", "stock_status")


@register("inventory_listing", f"""
, {INV_STATUS_SQL}
SELECT inventory_id, name, supplier_name, CAST(quantity AS DOUBLE) AS quantity,
       strftime(import_date, '%d/%m') AS import_day, strftime(expiry_date, '%d/%m') AS expiry_day,
       days_until_expiry, expiry_status, stock_status FROM ist""")
def q_inventory_listing(b):
    return stock.inventory_listing(_inv_status(b))


@register("inventory_status_counts", f", {INV_STATUS_SQL} SELECT expiry_status AS status, count(*) AS n FROM ist GROUP BY 1")
def q_inventory_status_counts(b):
    return stock.inventory_status_counts(_inv_status(b))


@register("restock_suggestions", f"""
, {INV_STATUS_SQL}
SELECT inventory_id, name, CAST(quantity AS DOUBLE) AS quantity, expiry_status, days_until_expiry
FROM ist WHERE expiry_status <> 'ok'""")
def q_restock_suggestions(b):
    return stock.restock_suggestions(_inv_status(b))


@register("expiry_notifications", f"""
, {INV_STATUS_SQL}
SELECT inventory_id, 'admin' AS target_role, 'expiry_warning' AS type,
       name || ' hết hạn sau ' || CAST(days_until_expiry AS VARCHAR) || ' ngày (' || expiry_status || ')' AS message
FROM ist WHERE expiry_status IN ('warning', 'critical')""")
def q_expiry_notifications(b):
    return stock.expiry_notifications(_inv_status(b))


@register("stock_bar", """
SELECT inventory_id, name, CAST(quantity AS DOUBLE) AS quantity,
       CASE WHEN quantity > 8 THEN 'high' WHEN quantity > 3 THEN 'medium' ELSE 'low' END AS level,
       CAST(least(CAST(100 AS DECIMAL(10,2)), quantity * 8) AS DOUBLE) AS width
FROM inventory""")
def q_stock_bar(b):
    return stock.stock_bar(b.inventory)


BOM_SQL = """bom AS (SELECT pi.inventory_id, oi.order_id, sum(oi.quantity * pi.qty_per_portion) AS need
  FROM orders_b o JOIN order_items oi ON oi.order_id = o.order_id
  JOIN product_ingredients pi ON pi.product_id = oi.product_id
  WHERE o.status = 'preparing' AND pi.inventory_id IN (SELECT inventory_id FROM inventory)
  GROUP BY pi.inventory_id, oi.order_id)"""


def _bom(b):
    return stock.bom_explosion(b.orders, b.order_lines, b.product_ingredients, b.inventory, status="preparing")


@register("bom_explosion", f", {BOM_SQL} SELECT inventory_id, order_id, CAST(need AS DOUBLE) AS need FROM bom")
def q_bom_explosion(b):
    return _bom(b)


@register("stock_update_from", f"""
, {BOM_SQL}, used AS (SELECT inventory_id, sum(need) AS used FROM bom GROUP BY inventory_id)
SELECT i.inventory_id, CAST(CASE WHEN u.used IS NULL THEN i.quantity ELSE greatest(i.quantity - u.used, 0) END AS DOUBLE) AS quantity
FROM inventory i LEFT JOIN used u ON u.inventory_id = i.inventory_id""")
def q_stock_update_from(b):
    return stock.stock_update_from(b.inventory, stock.need_by_item(_bom(b)))


LEDGER_ORDER_SQL = "ORDER BY created_at, order_id, line_no, action_type, quantity_change ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


@register("stock_running_balance", f"""
SELECT inventory_id, order_id, line_no,
       count(*) OVER (PARTITION BY inventory_id {LEDGER_ORDER_SQL}) AS seq,
       CAST(sum(quantity_change) OVER (PARTITION BY inventory_id {LEDGER_ORDER_SQL}) AS DOUBLE) AS balance
FROM inventory_logs""")
def q_stock_running_balance(b):
    return stock.stock_running_balance(b.inventory_logs)


@register("low_stock_notifications", f"""
, r AS (SELECT l.*, sum(quantity_change) OVER (PARTITION BY inventory_id {LEDGER_ORDER_SQL}) AS run FROM inventory_logs l),
x AS (SELECT r.*, i.name, i.quantity + r.run - r.quantity_change AS before, i.quantity + r.run AS after, i.min_quantity
      FROM r JOIN inventory i ON i.inventory_id = r.inventory_id)
SELECT inventory_id, order_id, line_no, created_at, 'admin' AS target_role, 'inventory_alert' AS type,
       'Cảnh báo kho nguyên liệu' AS title,
       'Nguyên liệu "' || name || '" còn ' || CAST(CAST(after AS DECIMAL(18,2)) AS VARCHAR) || ' (dưới mức tối thiểu)' AS message
FROM x WHERE before > min_quantity AND after <= min_quantity""")
def q_low_stock_notifications(b):
    return stock.low_stock_notifications(stock.low_stock_crossings(b.inventory_logs, b.inventory), b.inventory)


@register("low_stock_crossings", f"""
, r AS (SELECT l.*, sum(quantity_change) OVER (PARTITION BY inventory_id {LEDGER_ORDER_SQL}) AS run FROM inventory_logs l),
x AS (SELECT r.inventory_id, r.order_id, r.line_no, r.created_at, i.quantity + r.run - r.quantity_change AS before,
             i.quantity + r.run AS after, i.min_quantity
      FROM r JOIN inventory i ON i.inventory_id = r.inventory_id)
SELECT inventory_id, order_id, line_no, created_at, CAST(before AS DOUBLE) AS before, CAST(after AS DOUBLE) AS after
FROM x WHERE before > min_quantity AND after <= min_quantity""")
def q_low_stock_crossings(b):
    return stock.low_stock_crossings(b.inventory_logs, b.inventory)


# Stock floored at 0 after every ledger row: what the floor kept back is the running minimum under 0.
FLOORED_SQL = """c AS (SELECT l.*, i.name, i.min_quantity, i.quantity AS opening,
    row_number() OVER (PARTITION BY l.inventory_id ORDER BY created_at, order_id, line_no, action_type, quantity_change) AS rn,
    i.quantity + sum(quantity_change) OVER (PARTITION BY l.inventory_id
      ORDER BY created_at, order_id, line_no, action_type, quantity_change ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x
  FROM inventory_logs l JOIN inventory i ON i.inventory_id = l.inventory_id),
f AS (SELECT *, x - least(0, min(x) OVER (PARTITION BY inventory_id ORDER BY rn
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS after FROM c),
x AS (SELECT *, coalesce(lag(after) OVER (PARTITION BY inventory_id ORDER BY rn), opening) AS before FROM f)"""

FLOORED_CROSSINGS_SQL = f"""
, {FLOORED_SQL}
SELECT inventory_id, order_id, line_no, created_at, CAST(before AS DOUBLE) AS before, CAST(after AS DOUBLE) AS after
FROM x WHERE before > min_quantity AND after <= min_quantity"""


@register("low_stock_crossings_floored", FLOORED_CROSSINGS_SQL)
def q_low_stock_crossings_floored(b):
    return stock.low_stock_crossings_floored(b.inventory_logs, b.inventory)


@register("low_stock_notifications_floored", f"""
, {FLOORED_SQL}
SELECT inventory_id, order_id, line_no, created_at, 'admin' AS target_role, 'inventory_alert' AS type,
       'Cảnh báo kho nguyên liệu' AS title,
       'Nguyên liệu "' || name || '" còn ' || CAST(CAST(after AS DECIMAL(18,2)) AS VARCHAR) || ' (dưới mức tối thiểu)' AS message
FROM x WHERE before > min_quantity AND after <= min_quantity""")
def q_low_stock_notifications_floored(b):
    return stock.low_stock_notifications(stock.low_stock_crossings_floored(b.inventory_logs, b.inventory), b.inventory)


@register("fifo_allocation", """
, s AS (SELECT inventory_id, order_id AS batch_order, line_no AS batch_line, quantity_change AS q,
          sum(quantity_change) OVER (PARTITION BY inventory_id ORDER BY created_at, order_id, line_no, quantity_change
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi
        FROM inventory_logs WHERE action_type = 'import'),
d AS (SELECT inventory_id, order_id AS need_order, line_no AS need_line, -quantity_change AS q,
          sum(-quantity_change) OVER (PARTITION BY inventory_id ORDER BY created_at, order_id, line_no, -quantity_change
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi
        FROM inventory_logs WHERE action_type = 'export')
SELECT d.inventory_id, d.need_order, d.need_line, s.batch_order, s.batch_line,
       CAST(least(s.hi, d.hi) - greatest(s.hi - s.q, d.hi - d.q) AS DOUBLE) AS qty
FROM s JOIN d ON s.inventory_id = d.inventory_id AND s.hi - s.q < d.hi AND d.hi - d.q < s.hi""")
def q_fifo_allocation(b):
    return stock.fifo_ledger(b.inventory_logs)


@register("food_waste_pct", """
, a AS (SELECT sum(abs(quantity_change)) FILTER (WHERE action_type = 'waste') AS waste,
               sum(abs(quantity_change)) FILTER (WHERE action_type IN ('export', 'waste')) AS used
        FROM inventory_logs WHERE CAST(created_at AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-12-31')
SELECT CAST(waste AS DOUBLE) AS waste, CAST(used AS DOUBLE) AS used,
       CAST(waste AS DOUBLE) * 100.0 / CAST(used AS DOUBLE) AS waste_pct FROM a""")
def q_food_waste_pct(b):
    return stock.food_waste_pct(b.inventory_logs, date_from="1995-01-01", date_to="1996-12-31")


@register("receipts_today", """
, r AS (SELECT * FROM inventory_logs WHERE action_type = 'import' AND CAST(created_at AS DATE) = DATE '1996-03-13')
SELECT inventory_id, order_id, line_no, CAST(quantity_change AS DOUBLE) AS quantity, created_at,
       (SELECT count(*) FROM r) AS n_today FROM r""")
def q_receipts_today(b):
    return stock.receipts_today(b.inventory_logs, day="1996-03-13")


@register("ingredient_plan", f"""
, {BOM_SQL}, need AS (SELECT inventory_id, sum(need) AS need FROM bom GROUP BY inventory_id),
r AS (SELECT n.inventory_id, i.name, n.need, i.quantity AS stock, greatest(n.need - i.quantity, 0) AS shortfall,
             greatest(n.need - i.quantity, 0) * i.unit_price AS cost,
             CASE WHEN i.quantity < n.need * 0.3 THEN 'red' WHEN i.quantity < n.need * 0.7 THEN 'mid' ELSE 'ok' END AS band
      FROM need n JOIN inventory i ON i.inventory_id = n.inventory_id)
SELECT inventory_id, name, CAST(need AS DOUBLE) AS need, CAST(stock AS DOUBLE) AS stock,
       CAST(shortfall AS DOUBLE) AS shortfall, CAST(cost AS DOUBLE) AS cost, band FROM r
UNION ALL
SELECT NULL, 'TOTAL', CAST(sum(need) AS DOUBLE), CAST(sum(stock) AS DOUBLE), CAST(sum(shortfall) AS DOUBLE),
       CAST(sum(cost) AS DOUBLE), NULL FROM r""")
def q_ingredient_plan(b):
    return stock.ingredient_plan(stock.need_by_item(_bom(b)), b.inventory)


GROWTH_SQL = """g AS (SELECT inventory_id,
    CAST(coalesce(sum(-quantity_change) FILTER (WHERE CAST(created_at AS DATE) >= DATE '1996-03-13' - 7), 0) AS BIGINT) AS current,
    CAST(coalesce(sum(-quantity_change) FILTER (WHERE CAST(created_at AS DATE) < DATE '1996-03-13' - 7), 0) AS BIGINT) AS previous
  FROM inventory_logs WHERE action_type = 'export' AND CAST(created_at AS DATE) >= DATE '1996-03-13' - 14
    AND CAST(created_at AS DATE) < DATE '1996-03-13' GROUP BY inventory_id),
gg AS (SELECT inventory_id, current, CAST(CASE WHEN previous = 0 THEN 0
    ELSE floor((current - previous) * 100.0 / previous + 0.5) END AS BIGINT) AS growth FROM g)"""


@register("forecast_ingredients", f"""
, {GROWTH_SQL}
SELECT inventory_id, current, growth, CAST(floor((current * (100 + growth) + 50) / 100) AS BIGINT) AS next_week,
       growth >= 25 AS urgent FROM gg""")
def q_forecast_ingredients(b):
    return stock.forecast_ingredients(stock.weekly_usage_growth(b.inventory_logs, as_of="1996-03-13"))
