"""Supplier listings, search, shelf life and deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def suppliers_active(suppliers: DataFrame) -> DataFrame:
    return suppliers.filter("is_active").select("supplier_id", "name").orderBy("name", "supplier_id")


def supplier_search(suppliers: DataFrame, *, q: str = "", category=None) -> DataFrame:
    """Lower-cased ``q`` in name or contact, and category equality (None/'all' = any)."""
    s = suppliers
    q = (q or "").strip().lower()
    if q:
        s = s.filter(F.contains(F.lower("name"), F.lit(q))
                     | F.contains(F.lower(F.coalesce("contact_name", F.lit(""))), F.lit(q)))
    if category is not None and category != "all":
        s = s.filter(F.col("category") == F.lit(category))
    return s.select("supplier_id", "name")


def supplier_shelf_life(inventory: DataFrame) -> DataFrame:
    """Average days from import to expiry per supplier; ≤3 short, ≤7 medium, else long (fixed values)."""
    g = (inventory.filter(F.col("supplier_id").isNotNull())
         .groupBy("supplier_id")
         .agg(F.sum(F.datediff("expiry_date", "import_date")).alias("_d"), F.count(F.lit(1)).alias("_n")))
    avg = F.col("_d").cast("double") / F.col("_n")
    return g.select("supplier_id", avg.alias("avg_days"),
                    F.when(avg <= 3, "short").when(avg <= 7, "medium").otherwise("long").alias("band"))


def supplier_deliveries(logs: DataFrame, inventory: DataFrame) -> DataFrame:
    """Goods receipts per supplier, day and item name: count and quantity (no list is gathered)."""
    inv = inventory.select("inventory_id", "supplier_id", "name")
    r = (logs.filter(F.col("action_type") == "import")
         .join(inv, "inventory_id").filter(F.col("supplier_id").isNotNull()))
    return r.groupBy("supplier_id", F.to_date("created_at").alias("day"), F.col("name").alias("item")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("quantity_change").alias("qty"))
