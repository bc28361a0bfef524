"""Explicit schemas.

``RAW`` are the driver-provided star-schema tables; ``DOMAIN`` are the 19
tables of the meal-ordering data model. Reading with a schema skips
inference and lets Catalyst prune columns at the scan.
"""

from pyspark.sql import types as T

L, I, S, D, B = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType(), T.BooleanType()
TS = T.TimestampNTZType()
DT = T.DateType()


def dec(p, s):
    return T.DecimalType(p, s)


def st(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


RAW = {
    "region": st(("r_regionkey", I), ("r_name", S)),
    "nation": st(("n_nationkey", I), ("n_name", S), ("n_regionkey", I)),
    "customer": st(("c_custkey", L), ("c_name", S), ("c_nationkey", I),
                   ("c_acctbal", D), ("c_mktsegment", S)),
    "supplier": st(("s_suppkey", L), ("s_name", S), ("s_nationkey", I), ("s_acctbal", D)),
    "part": st(("p_partkey", L), ("p_name", S), ("p_brand", S), ("p_type", S),
               ("p_size", I), ("p_retailprice", D)),
    "orders": st(("o_orderkey", L), ("o_custkey", L), ("o_orderstatus", S),
                 ("o_totalprice", D), ("o_orderdate", TS), ("o_orderpriority", S)),
    "lineitem": st(("l_orderkey", L), ("l_partkey", L), ("l_suppkey", L),
                   ("l_linenumber", I), ("l_quantity", D), ("l_extendedprice", D),
                   ("l_discount", D), ("l_tax", D), ("l_returnflag", S),
                   ("l_linestatus", S), ("l_shipdate", TS)),
    "events": st(("event_id", L), ("ts", TS), ("user_id", L), ("event_type", S),
                 ("value", D), ("props", S)),
}

# The 19 tables of the data model (types follow the reference DDL; money is
# decimal, "now" defaults are not materialised).
DOMAIN = {
    "users": st(("user_id", L), ("email", S), ("full_name", S), ("phone", S), ("role", S),
                ("is_active", B), ("loyalty_points", I), ("last_login", TS)),
    "categories": st(("category_id", I), ("name", S), ("slug", S), ("icon", S)),
    "products": st(("product_id", L), ("category_id", I), ("name", S), ("description", S),
                   ("price", dec(18, 2)), ("calories", I), ("protein_g", dec(5, 1)),
                   ("carbs_g", dec(5, 1)), ("fat_g", dec(5, 1)), ("health_tags", S),
                   ("prep_time_min", I), ("is_available", B), ("created_at", TS)),
    "subscription_plans": st(("plan_id", I), ("name", S), ("description", S),
                             ("price_weekly", dec(10, 0)), ("price_monthly", dec(10, 0)),
                             ("meals_per_day", I), ("days_per_week", I), ("is_active", B)),
    "subscriptions": st(("subscription_id", L), ("user_id", L), ("plan_id", I),
                        ("start_date", DT), ("end_date", DT), ("status", S),
                        ("period", S), ("price", dec(10, 0)), ("created_at", TS)),
    "delivery_addresses": st(("address_id", L), ("user_id", L), ("label", S),
                             ("address", S), ("is_default", B)),
    "orders": st(("order_id", L), ("order_code", S), ("user_id", L), ("order_type", S),
                 ("status", S), ("delivery_name", S), ("delivery_phone", S),
                 ("delivery_address", S), ("delivery_timeslot", S), ("subtotal", dec(18, 2)),
                 ("discount_amount", dec(18, 2)), ("total", dec(18, 2)), ("voucher_code", S),
                 ("payment_method", S), ("payment_status", S), ("created_at", TS),
                 ("confirmed_at", TS), ("preparing_at", TS), ("ready_at", TS),
                 ("delivered_at", TS)),
    "order_items": st(("order_id", L), ("line_no", I), ("product_id", L), ("quantity", I),
                      ("unit_price", dec(18, 2)), ("subtotal", dec(18, 2)), ("notes", S),
                      ("calories_snapshot", I), ("protein_snapshot", dec(5, 1)),
                      ("carbs_snapshot", dec(5, 1)), ("fat_snapshot", dec(5, 1))),
    "suppliers": st(("supplier_id", L), ("name", S), ("contact_name", S), ("phone", S),
                    ("category", S), ("notes", S), ("is_active", B)),
    "inventory": st(("inventory_id", L), ("inventory_code", S), ("supplier_id", L),
                    ("name", S), ("category", S), ("unit", S), ("quantity", dec(10, 2)),
                    ("min_quantity", dec(10, 2)), ("unit_price", dec(18, 2)),
                    ("import_date", DT), ("expiry_date", DT), ("batch_number", S),
                    ("updated_at", TS)),
    "product_ingredients": st(("product_id", L), ("inventory_id", L),
                              ("qty_per_portion", dec(10, 3))),
    "inventory_logs": st(("log_id", L), ("inventory_id", L), ("order_id", L),
                         ("action_type", S), ("quantity_change", dec(10, 2)),
                         ("quantity_after", dec(10, 2)), ("reason", S), ("created_at", TS)),
    "menu_schedule": st(("schedule_id", L), ("schedule_date", DT), ("product_id", L),
                        ("meal_type", S), ("max_quantity", I)),
    "vouchers": st(("voucher_id", L), ("code", S), ("discount_type", S),
                   ("discount_value", dec(10, 2)), ("max_discount", dec(10, 0)),
                   ("min_order", dec(10, 0)), ("max_uses", I), ("used_count", I),
                   ("condition_type", S), ("starts_at", TS), ("expires_at", DT),
                   ("is_active", B)),
    "voucher_usages": st(("usage_id", L), ("voucher_id", L), ("order_id", L),
                         ("user_id", L), ("discount_amount", dec(18, 2)), ("used_at", TS)),
    "shippers": st(("shipper_id", L), ("full_name", S), ("phone", S),
                   ("last_lat", dec(10, 7)), ("last_lng", dec(10, 7)), ("last_seen", TS)),
    "shipper_tracking": st(("event_id", L), ("order_id", L), ("shipper_id", L),
                           ("latitude", dec(10, 7)), ("longitude", dec(10, 7)),
                           ("recorded_at", TS)),
    "loyalty_transactions": st(("txn_id", L), ("user_id", L), ("order_id", L),
                               ("points_change", I), ("reason", S), ("created_at", TS)),
    "notifications": st(("notification_id", L), ("target_role", S), ("user_id", L),
                        ("type", S), ("title", S), ("message", S), ("is_read", B),
                        ("created_at", TS)),
}

# Stream payloads (socket messages of the reference, re-aimed as sources).
NEW_ORDER_EVENT = st(("id", L), ("type", S), ("customer", S), ("status", S),
                     ("arrivedAt", L),
                     ("items", T.ArrayType(st(("name", S), ("qty", I), ("notes", S)))))
STATUS_EVENT = st(("event_id", L), ("order_id", L), ("status", S), ("ts", TS))
POSITION_EVENT = st(("event_id", L), ("order_id", L), ("shipper_id", L),
                    ("latitude", dec(10, 7)), ("longitude", dec(10, 7)), ("recorded_at", TS))
ORDER_ITEM_REQUEST = T.ArrayType(st(("product_id", L), ("qty", I), ("notes", S)))
