"""JSON text columns -> rows (built-in ``from_json`` + generators)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .schemas import ORDER_ITEM_REQUEST


def parse_order_items(requests: DataFrame, json_col: str = "items_json",
                      keys=("order_id", "line_no")) -> DataFrame:
    """Items array text -> one row per item (product_id, qty, notes).

    Fields outside the schema are dropped, absent ones become NULL; a
    malformed array yields no rows.
    """
    arr = F.from_json(F.col(json_col), ORDER_ITEM_REQUEST)
    return requests.select(*keys, F.inline_outer(arr)).filter(F.col("product_id").isNotNull())


def parse_health_tags(products: DataFrame) -> DataFrame:
    """Health tags text (JSON array) -> one row per (product_id, tag)."""
    arr = F.from_json(F.col("health_tags"), "array<string>")
    return products.select("product_id", F.explode(arr).alias("tag"))


def tags_array(col: str = "health_tags"):
    return F.coalesce(F.from_json(F.col(col), "array<string>"), F.array().cast("array<string>"))
