"""The bindings of ``mealops.sources.bind`` written once more as plain SQL.

These are the leading CTEs of every DuckDB oracle query. They restate the
same rules independently of the DataFrame code, so a binding mistake on
either side shows up as a mismatch.
"""

BINDINGS = {
    "users": """
SELECT c_custkey AS user_id, c_name AS full_name,
       CASE c_custkey % 50 WHEN 0 THEN 'admin' WHEN 1 THEN 'kitchen' ELSE 'customer' END AS role,
       c_custkey % 7 <> 0 AS is_active
FROM customer""",
    "products": """
SELECT p_partkey AS product_id, p_name AS name, p_brand AS description, p_type AS category,
       concat('["', p_type, '","', p_brand, '"]') AS health_tags,
       CAST(p_retailprice AS DECIMAL(18,2)) AS price, 200 + 8 * p_size AS calories,
       CAST(10 + p_size % 40 AS DECIMAL(5,1)) AS protein_g,
       CAST(5 + (p_size * 3) % 60 AS DECIMAL(5,1)) AS carbs_g,
       CAST(2 + (p_size * 7) % 35 AS DECIMAL(5,1)) AS fat_g,
       p_partkey % 11 <> 0 AS is_available
FROM part""",
    "categories": """
SELECT name, lower(replace(name, ' ', '-')) AS slug FROM (SELECT DISTINCT p_type AS name FROM part) t""",
    "orders_b": """
SELECT o_orderkey AS order_id, 'FF-' || CAST(o_orderkey AS VARCHAR) AS order_code,
       CASE WHEN o_custkey % 20 = 0 THEN NULL ELSE o_custkey END AS user_id,
       CASE WHEN o_orderpriority = '5-LOW' THEN 'cancelled' WHEN o_orderstatus = 'F' THEN 'done'
            WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'preparing' END AS status,
       CASE WHEN o_custkey % 5 = 0 THEN 'walkin' ELSE 'online' END AS order_type,
       CAST(o_totalprice AS DECIMAL(18,2)) AS subtotal,
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.01 AS DECIMAL(3,2)) * CAST(o_orderkey % 4 AS DECIMAL(1,0)) AS DECIMAL(18,2)) AS discount_amount,
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) - CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.01 AS DECIMAL(3,2)) * CAST(o_orderkey % 4 AS DECIMAL(1,0)) AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS total,
       CASE o_orderkey % 6 WHEN 0 THEN '07:00 - 09:00' WHEN 1 THEN '09:00 - 11:00' WHEN 2 THEN '11:00 - 13:00'
            WHEN 3 THEN '13:00 - 15:00' WHEN 4 THEN '15:00 - 17:00' ELSE '17:00 - 20:00' END AS delivery_timeslot,
       CASE o_orderkey % 5 WHEN 0 THEN 'cod' WHEN 1 THEN 'bank' WHEN 2 THEN 'momo' WHEN 3 THEN 'zalopay' ELSE 'cash' END AS payment_method,
       o_orderdate AS created_at
FROM orders""",
    "order_items": """
SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS product_id,
       CAST(l_quantity AS INT) AS quantity, p.price AS unit_price,
       CAST(l_extendedprice AS DECIMAL(18,2)) AS subtotal,
       p.calories AS calories_snapshot, p.protein_g AS protein_snapshot,
       p.carbs_g AS carbs_snapshot, p.fat_g AS fat_snapshot
FROM lineitem JOIN products p ON p.product_id = l_partkey""",
    "suppliers": """
SELECT s_suppkey AS supplier_id, s_name AS name, 'contact-' || CAST(s_nationkey AS VARCHAR) AS contact_name,
       s_nationkey AS category, s_acctbal > 0 AS is_active
FROM supplier""",
    "shippers": """
SELECT s_suppkey AS shipper_id, s_name AS full_name, '09' || CAST(s_suppkey AS VARCHAR) AS phone FROM supplier""",
    "inventory": """
SELECT p_partkey AS inventory_id, 'INV-' || CAST(p_partkey AS VARCHAR) AS inventory_code,
       CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_partkey % 10 END AS supplier_id,
       p_name AS name, p_type AS category,
       CAST(p_size - 5 AS DECIMAL(10,2)) AS quantity, CAST(10 AS DECIMAL(10,2)) AS min_quantity,
       CAST(p_retailprice AS DECIMAL(18,2)) AS unit_price,
       DATE '2001-08-01' + CAST(p_partkey % 12 - 3 AS INT) - CAST(5 + p_partkey % 10 AS INT) AS import_date,
       DATE '2001-08-01' + CAST(p_partkey % 12 - 3 AS INT) AS expiry_date
FROM part""",
    "product_ingredients": """
SELECT p_partkey AS product_id, (p_partkey * 7 + k.k * 13) % n.n AS inventory_id,
       CAST(0.05 AS DECIMAL(3,2)) * CAST(k.k AS DECIMAL(1,0)) AS qty_per_portion
FROM part CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3) k
     CROSS JOIN (SELECT count(*) AS n FROM part) n""",
    "vouchers": """
SELECT CAST(n_nationkey AS BIGINT) AS voucher_id, upper(n_name) AS code,
       CASE WHEN n_nationkey % 2 = 0 THEN 'percent' ELSE 'fixed' END AS discount_type,
       CAST(CASE WHEN n_nationkey % 2 = 0 THEN 5 * (1 + n_nationkey % 5) ELSE 1000 * (1 + n_nationkey % 3) END AS DECIMAL(10,2)) AS discount_value,
       CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE CAST(20000 AS DECIMAL(10,0)) END AS max_discount,
       CAST(50000 * (n_nationkey % 4) AS DECIMAL(10,0)) AS min_order,
       CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE 30 END AS max_uses,
       n_nationkey * 2 AS used_count,
       CASE n_nationkey % 4 WHEN 0 THEN 'all' WHEN 1 THEN 'new_user' WHEN 2 THEN 'first_order' ELSE 'subscription' END AS condition_type,
       CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE DATE '2001-08-01' + CAST(n_nationkey - 8 AS INT) END AS expires_at,
       n_nationkey % 8 <> 7 AS is_active
FROM nation""",
    "subscriptions": """
SELECT event_id AS subscription_id, user_id, CAST(event_id % 3 + 1 AS INT) AS plan_id,
       CAST(ts AS DATE) AS start_date,
       CAST(ts AS DATE) + CASE WHEN event_id % 4 = 0 THEN 30 ELSE 7 END AS end_date,
       CASE event_id % 5 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'paused' ELSE 'active' END AS status,
       CASE WHEN event_id % 4 = 0 THEN 'monthly' ELSE 'weekly' END AS period,
       ts AS created_at
FROM events WHERE event_type = 'signup'""",
    "plans": """
SELECT * FROM (VALUES
  (1, 'Starter Clean', CAST(490000 AS DECIMAL(10,0)), CAST(1750000 AS DECIMAL(10,0)), 1, 5, true),
  (2, 'Full Day', CAST(820000 AS DECIMAL(10,0)), CAST(2950000 AS DECIMAL(10,0)), 2, 5, true),
  (3, 'Total Wellness', CAST(1150000 AS DECIMAL(10,0)), CAST(4200000 AS DECIMAL(10,0)), 3, 7, true))
  AS t(plan_id, name, price_weekly, price_monthly, meals_per_day, days_per_week, is_active)""",
    "inventory_logs": """
SELECT l_partkey AS inventory_id, l_orderkey AS order_id, l_linenumber AS line_no,
       CASE l_returnflag WHEN 'R' THEN 'waste' WHEN 'A' THEN 'import' ELSE 'export' END AS action_type,
       CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS DECIMAL(10,2)) ELSE -CAST(l_quantity AS DECIMAL(10,2)) END AS quantity_change,
       l_shipdate AS created_at
FROM lineitem""",
    "status_events": """
SELECT event_id, user_id AS order_id,
       CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'confirmed' WHEN 'click' THEN 'preparing'
            WHEN 'purchase' THEN 'ready' ELSE 'cancelled' END AS status, ts
FROM events""",
    "pings": """
SELECT event_id, user_id AS order_id, event_id % 10 AS shipper_id,
       CAST(10 + CAST(value AS DECIMAL(10,2)) * CAST(0.001 AS DECIMAL(4,3)) AS DECIMAL(10,7)) AS latitude,
       CAST(106 + CAST(event_id % 1000 AS DECIMAL(4,0)) * CAST(0.0001 AS DECIMAL(5,4)) AS DECIMAL(10,7)) AS longitude,
       ts AS recorded_at
FROM events""",
    "menu_schedule": """
SELECT p_partkey AS schedule_id, DATE '1998-01-05' + CAST(p_partkey % 28 AS INT) AS schedule_date,
       p_partkey AS product_id,
       CASE p_partkey % 3 WHEN 0 THEN 'breakfast' WHEN 1 THEN 'lunch' ELSE 'dinner' END AS meal_type,
       1 + p_size % 5 AS max_quantity
FROM part""",
    "voucher_usages": """
SELECT order_id AS usage_id, order_id % 25 AS voucher_id, order_id, user_id, discount_amount,
       created_at AS used_at
FROM orders_b WHERE discount_amount > 0""",
    "notifications": """
SELECT event_id AS notification_id,
       CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'kitchen' ELSE 'admin' END END AS target_role,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END AS user_id,
       event_type AS type, 'evt ' || CAST(event_id AS VARCHAR) AS title,
       event_id % 4 = 0 AS is_read, ts AS created_at
FROM events""",
    "logins": """
SELECT user_id, ts AS login_at FROM events WHERE event_type = 'signup'""",
    "cart_events": """
SELECT event_id, user_id, event_id % 10 AS product_id,
       CASE event_type WHEN 'click' THEN 'add' WHEN 'error' THEN 'set' ELSE 'clear' END AS action,
       CAST(CASE event_type WHEN 'click' THEN 1 + event_id % 3 WHEN 'error' THEN event_id % 3 - 1 END AS INT) AS qty,
       CASE WHEN event_type = 'click' THEN 'note ' || CAST(event_id AS VARCHAR) END AS notes,
       ts
FROM events WHERE event_type IN ('click', 'error', 'purchase')""",
    "subscribe_requests": """
SELECT event_id AS request_id, user_id,
       CASE event_id % 4 WHEN 0 THEN 'basic' WHEN 1 THEN 'standard' WHEN 2 THEN 'premium' ELSE 'gold' END AS plan,
       CASE WHEN event_id % 2 = 0 THEN 'weekly' ELSE 'monthly' END AS period, ts
FROM events WHERE event_type = 'purchase'""",
    "lifecycle_events": """
SELECT event_id, user_id, CASE event_type WHEN 'view' THEN 'pause' WHEN 'click' THEN 'renew' ELSE 'cancel' END AS action, ts
FROM events WHERE event_type IN ('view', 'click', 'error')""",
    "voucher_requests": """
SELECT o.order_id, o.user_id, o.subtotal, o.created_at,
       CASE WHEN o.order_id % 7 = 0 THEN 'nope' ELSE lower(v.code) END AS voucher_code
FROM orders_b o LEFT JOIN vouchers v ON v.voucher_id = o.order_id % 25""",
    "receipts": """
SELECT (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey % 1000000 AS receipt_id,
       CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE 'item ' || CAST(l_partkey AS VARCHAR) END AS name,
       CAST(l_quantity AS DECIMAL(10,2)) AS quantity, CAST(l_shipdate AS DATE) + 30 AS expiry_date,
       l_suppkey % 10 AS supplier_id, CAST(l_extendedprice AS DECIMAL(18,2)) AS unit_price
FROM lineitem WHERE l_returnflag = 'A'""",
    "adjustments": """
SELECT event_id, 'INV-' || CAST(user_id AS VARCHAR) AS inventory_code, CAST(value AS DECIMAL(10,2)) AS quantity,
       'stock count' AS reason, ts
FROM events WHERE event_type = 'view'""",
    "product_feed": """
SELECT CASE WHEN l_linenumber = 7 THEN l_partkey + 100000000 ELSE l_partkey END AS product_id,
       CASE WHEN l_linenumber = 6 THEN NULL ELSE 'feed ' || CAST(l_partkey AS VARCHAR) END AS name,
       CAST(l_extendedprice AS DECIMAL(18,2)) AS price, CAST(NULL AS INT) AS calories,
       l_shipdate AS ts, l_orderkey AS seq1, l_linenumber AS seq2
FROM lineitem""",
    "requests": """
SELECT l_orderkey AS order_id, l_linenumber AS line_no,
       '[{"product_id":' || CAST(l_partkey AS VARCHAR) || ',"qty":' || CAST(CAST(l_quantity AS INT) AS VARCHAR)
       || ',"notes":"n' || CAST(l_linenumber AS VARCHAR) || '","price":1.5},{"product_id":'
       || CAST(l_suppkey AS VARCHAR) || ',"qty":1}]' AS items_json
FROM lineitem""",
    "voucher_feed": """
SELECT CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE ' ' || lower(coalesce(v.code, 'new' || CAST(s_suppkey % 40 AS VARCHAR))) || ' ' END AS code,
       CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 2 = 0 THEN 'percent' ELSE 'fixed' END AS discount_type,
       CAST(5 + s_suppkey % 20 AS DECIMAL(10,2)) AS discount_value, CAST(NULL AS DECIMAL(10,0)) AS min_order, s_suppkey AS seq
FROM supplier LEFT JOIN vouchers v ON v.voucher_id = s_suppkey % 40""",
    "supplier_feed": """
SELECT c_custkey % 150 AS supplier_id, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 'supplier ' || CAST(c_custkey AS VARCHAR) END AS name,
       CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 'new contact ' || CAST(c_custkey AS VARCHAR) END AS contact_name, c_custkey AS seq
FROM customer""",
    "checked_users": """
SELECT user_id, CASE WHEN user_id % 41 = 0 THEN NULL ELSE full_name END AS full_name,
       CASE WHEN user_id % 43 = 0 THEN 'guest' ELSE role END AS role, is_active,
       'u' || CAST(CASE WHEN user_id % 37 = 0 THEN 0 ELSE user_id END AS VARCHAR) || '@mail.test' AS email FROM users""",
    "checked_orders": """
SELECT order_id, order_code, CASE WHEN order_id % 83 = 0 THEN user_id + 100000000 ELSE user_id END AS user_id, status, order_type,
       CASE WHEN order_id % 97 = 0 THEN 'card' ELSE payment_method END AS payment_method,
       CASE WHEN order_id % 89 = 0 THEN 'lost' WHEN order_id % 3 = 0 THEN 'paid' WHEN order_id % 7 = 0 THEN 'refunded' ELSE 'pending' END AS payment_status,
       subtotal, discount_amount, total, created_at FROM orders_b""",
    "checked_order_items": """
SELECT l_orderkey AS order_id, l_linenumber AS line_no,
       CASE WHEN l_linenumber = 7 THEN l_partkey + 100000000 ELSE l_partkey END AS product_id,
       CAST(l_quantity AS INT) AS quantity FROM lineitem""",
    "checked_vouchers": """
SELECT voucher_id, CASE WHEN voucher_id % 11 = 0 THEN 'TWICE' ELSE code END AS code, discount_type, discount_value, condition_type, used_count
FROM vouchers""",
    "checked_voucher_usages": """
SELECT usage_id, CASE WHEN usage_id % 79 = 0 THEN 99 ELSE voucher_id END AS voucher_id, order_id, user_id, discount_amount FROM voucher_usages""",
    "checked_subscriptions": """
SELECT subscription_id, user_id, CASE WHEN subscription_id % 71 = 0 THEN 9 ELSE plan_id END AS plan_id, status, period, start_date, end_date, created_at
FROM subscriptions""",
    "delivery_addresses": """
SELECT c_custkey * 2 + nth AS address_id, c_custkey AS user_id, CASE WHEN nth = 0 THEN 'home' ELSE 'office' END AS label,
       'nation ' || CAST(c_nationkey AS VARCHAR) AS address, nth = 0 AS is_default
FROM customer, (VALUES (0), (1)) n(nth) WHERE nth = 0 OR c_custkey % 4 = 0""",
    "loyalty_transactions": """
SELECT order_id AS txn_id, user_id, order_id, CAST(floor((subtotal - discount_amount) / 10000) AS INT) AS points_change,
       'order' AS reason, created_at
FROM orders_b WHERE user_id IS NOT NULL AND floor((subtotal - discount_amount) / 10000) > 0""",
    "checked_delivery_addresses": """
SELECT address_id, CASE WHEN address_id % 61 = 0 THEN NULL WHEN address_id % 67 = 0 THEN user_id + 100000000 ELSE user_id END AS user_id,
       CASE WHEN address_id % 59 = 0 THEN NULL ELSE address END AS address
FROM delivery_addresses""",
    "checked_loyalty_transactions": """
SELECT txn_id, CASE WHEN txn_id % 101 = 0 THEN user_id + 100000000 ELSE user_id END AS user_id,
       CASE WHEN txn_id % 103 = 0 THEN order_id + 100000000 ELSE order_id END AS order_id,
       CASE WHEN txn_id % 73 = 0 THEN NULL ELSE points_change END AS points_change
FROM loyalty_transactions""",
    "order_requests": """
SELECT v.order_id, v.user_id, v.created_at, v.voucher_code, o.order_type, o.payment_method, o.delivery_timeslot
FROM voucher_requests v JOIN orders_b o ON o.order_id = v.order_id""",
    "order_request_items": """
SELECT order_id, line_no, CASE WHEN order_id % 11 = 0 THEN '[{"product_id":-1,"qty":1}]' ELSE items_json END AS items_json
FROM requests""",
}


def with_bindings(body: str) -> str:
    """Prefix ``body`` with every binding as a CTE.

    ``body`` is either a SELECT, or further CTEs introduced by a leading
    comma (``", x AS (...) SELECT ..."``) that may use the bindings.
    """
    ctes = ",\n".join(f"{name} AS ({sql.strip()})" for name, sql in BINDINGS.items())
    body = body.strip()
    if body.startswith(","):
        return f"WITH {ctes}{body}"
    return f"WITH {ctes}\n{body}"
