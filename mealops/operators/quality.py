"""Data-quality checks: NOT NULL, CHECK domains, UNIQUE and foreign keys.

Each rule is a filter, a grouped HAVING or an anti join; the results are a
union of (table_name, rule, key) rows, the key rendered as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spread import spread

# CHECK domains of the data model.
DOMAINS = {
    ("users", "role"): ["admin", "kitchen", "customer"],
    ("subscriptions", "status"): ["active", "paused", "cancelled", "expired"],
    ("subscriptions", "period"): ["weekly", "monthly"],
    ("orders", "order_type"): ["online", "walkin"],
    ("orders", "status"): ["pending", "confirmed", "preparing", "ready", "delivering", "done", "cancelled"],
    ("orders", "payment_method"): ["cod", "bank", "momo", "zalopay", "cash"],
    ("orders", "payment_status"): ["pending", "paid", "refunded"],
    ("inventory_logs", "action_type"): ["import", "export", "adjust", "waste"],
    ("menu_schedule", "meal_type"): ["breakfast", "lunch", "dinner", "snack"],
    ("vouchers", "discount_type"): ["percent", "fixed"],
    ("vouchers", "condition_type"): ["all", "new_user", "subscription", "first_order"],
}

NOT_NULL = {
    "users": ["user_id", "email", "full_name", "role", "is_active"],
    "categories": ["name", "slug"],
    "products": ["product_id", "name", "price", "calories", "protein_g", "carbs_g", "fat_g", "is_available"],
    "delivery_addresses": ["user_id", "address"],
    "orders": ["order_id", "order_code", "status", "order_type", "subtotal", "discount_amount", "total", "created_at"],
    "suppliers": ["name"],
    "inventory": ["inventory_id", "inventory_code", "name", "category", "quantity", "import_date", "expiry_date"],
    "vouchers": ["voucher_id", "code", "discount_type", "discount_value", "used_count"],
    "order_items": ["order_id", "product_id", "quantity"],
    "subscriptions": ["user_id", "plan_id", "start_date", "end_date", "status", "period", "created_at"],
    "inventory_logs": ["inventory_id", "action_type", "quantity_change"],
    "product_ingredients": ["product_id", "inventory_id", "qty_per_portion"],
    "menu_schedule": ["schedule_date", "product_id", "meal_type"],
    "voucher_usages": ["voucher_id", "order_id", "discount_amount"],
    "loyalty_transactions": ["user_id", "points_change"],
    "pings": ["order_id", "shipper_id", "latitude", "longitude"],
}

UNIQUE = {
    "users": [["email"]],
    "orders": [["order_code"]],
    "inventory": [["inventory_code"]],
    "vouchers": [["code"]],
    "categories": [["slug"]],
    "menu_schedule": [["schedule_date", "product_id", "meal_type"]],
    "product_ingredients": [["product_id", "inventory_id"]],
}

# (child table, child columns, parent table, parent columns, child key columns)
FOREIGN_KEYS = [
    ("order_items", ["order_id"], "orders", ["order_id"], ["order_id", "line_no"]),
    ("order_items", ["product_id"], "products", ["product_id"], ["order_id", "line_no"]),
    ("orders", ["user_id"], "users", ["user_id"], ["order_id"]),
    ("inventory", ["supplier_id"], "suppliers", ["supplier_id"], ["inventory_id"]),
    ("product_ingredients", ["product_id"], "products", ["product_id"], ["product_id", "inventory_id"]),
    ("product_ingredients", ["inventory_id"], "inventory", ["inventory_id"], ["product_id", "inventory_id"]),
    ("subscriptions", ["plan_id"], "plans", ["plan_id"], ["subscription_id"]),
    ("subscriptions", ["user_id"], "users", ["user_id"], ["subscription_id"]),
    ("pings", ["shipper_id"], "shippers", ["shipper_id"], ["event_id"]),
    ("voucher_usages", ["voucher_id"], "vouchers", ["voucher_id"], ["usage_id"]),
    ("voucher_usages", ["order_id"], "orders", ["order_id"], ["usage_id"]),
    ("voucher_usages", ["user_id"], "users", ["user_id"], ["usage_id"]),
    ("menu_schedule", ["product_id"], "products", ["product_id"], ["schedule_id"]),
    ("inventory_logs", ["inventory_id"], "inventory", ["inventory_id"], ["inventory_id", "order_id", "line_no"]),
    ("pings", ["order_id"], "orders", ["order_id"], ["event_id"]),
    ("products", ["category"], "categories", ["name"], ["product_id"]),
    ("inventory_logs", ["order_id"], "orders", ["order_id"], ["inventory_id", "order_id", "line_no"]),
    ("delivery_addresses", ["user_id"], "users", ["user_id"], ["address_id"]),
    ("loyalty_transactions", ["user_id"], "users", ["user_id"], ["txn_id"]),
    ("loyalty_transactions", ["order_id"], "orders", ["order_id"], ["txn_id"]),
    ("notifications", ["user_id"], "users", ["user_id"], ["notification_id"]),
]


def _key(cols) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])


def _row(df: DataFrame, table: str, rule: str, cols) -> DataFrame:
    return df.select(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), _key(cols).alias("key"))


def orphan_check(frames: dict[str, DataFrame], fks=FOREIGN_KEYS) -> list[DataFrame]:
    """Child rows whose non-null reference has no parent.

    The references of all children of one parent key are stacked and joined
    (left anti) with it. Spark joins each child by itself; they share the
    parent's shuffle, whose number of tasks follows the references.
    """
    by_parent: dict[tuple, list] = {}
    for child, ccols, parent, pcols, kcols in fks:
        if child in frames and parent in frames and set(ccols) <= set(frames[child].columns):
            by_parent.setdefault((parent, tuple(pcols)), []).append((child, ccols, kcols))
    out = []
    for (parent, pcols), children in by_parent.items():
        refs = []
        for child, ccols, kcols in children:
            ref = [F.col(c).cast(frames[parent].schema[p].dataType).alias(f"_r{i}")
                   for i, (c, p) in enumerate(zip(ccols, pcols, strict=True))]
            named = frames[child].select(F.lit(child).alias("table_name"), F.lit(f"fk_{'_'.join(ccols)}_{parent}").alias("rule"),
                                         _key(kcols).alias("key"), *ref)
            refs.append(named.dropna(subset=[f"_r{i}" for i in range(len(pcols))]))
        names = [f"_r{i}" for i in range(len(pcols))]
        p = frames[parent].select(*[F.col(c).alias(n) for n, c in zip(names, pcols, strict=True)])
        orphans = union_all(refs).join(spread(p, names, refs), names, "left_anti")
        out.append(orphans.select("table_name", "rule", "key"))
    return out


def row_rules(frames: dict[str, DataFrame], key_cols: dict[str, list[str]]) -> list[DataFrame]:
    """CHECK and NOT NULL rules: one pass per table.

    Every rule of a table becomes ``when(violated, rule_name)`` in one array;
    the non-null entries are exploded, so a table is scanned once however
    many rules it has.
    """
    per_table: dict[str, list] = {}
    for (t, c), allowed in DOMAINS.items():
        if t in frames and c in frames[t].columns:
            per_table.setdefault(t, []).append(
                F.when(F.col(c).isNotNull() & ~F.col(c).isin(*allowed), F.lit(f"check_{c}")))
    for t, cols in NOT_NULL.items():
        if t in frames:
            for c in [c for c in cols if c in frames[t].columns]:
                per_table.setdefault(t, []).append(F.when(F.col(c).isNull(), F.lit(f"not_null_{c}")))
    out = []
    for t, rules in per_table.items():
        hits = F.filter(F.array(*rules), lambda x: x.isNotNull())
        out.append(frames[t].select(F.lit(t).alias("table_name"), F.explode(hits).alias("rule"),
                                    _key(key_cols[t]).alias("key")))
    return out


def validate_constraints(frames: dict[str, DataFrame], key_cols: dict[str, list[str]]) -> DataFrame:
    """All violations as (table_name, rule, key)."""
    parts: list[DataFrame] = row_rules(frames, key_cols)
    for t, groups in UNIQUE.items():
        if t in frames:
            for cols in [g for g in groups if set(g) <= set(frames[t].columns)]:
                keys = frames[t].select(*cols)
                dup = (spread(keys, cols, [keys]).groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1))
                parts.append(_row(dup, t, f"unique_{'_'.join(cols)}", cols))
    parts.extend(orphan_check(frames))
    return union_all(parts)


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
