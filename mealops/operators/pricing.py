"""Vouchers, loyalty points and the batch order-creation composite."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import lit_date
from ..functions.windows import prefix_sums, time_bucket
from ..session import checkpoint_dir
from ..sources.parse import parse_order_items
from ..sources.versions import VersionedTables
from .orders import order_notifications, price_order_items


def usable(as_of) -> Column:
    """Active, not expired at ``as_of``, uses left. starts_at and condition are not checked."""
    now = lit_date(as_of)
    return (F.col("is_active")
            & (F.col("expires_at").isNull() | (F.col("expires_at") > now))
            & (F.col("max_uses").isNull() | (F.col("used_count") < F.col("max_uses"))))


def usable_vouchers(vouchers: DataFrame, *, as_of) -> DataFrame:
    return vouchers.filter(usable(as_of)).select("voucher_id", "code")


def voucher_discount(subtotal: Column) -> Column:
    """Discount before the validity test: percent capped at max_discount, or fixed.

    Computed in exact decimals and stored as DECIMAL(10,0) (half up).
    """
    pct = subtotal * F.col("discount_value") * F.lit(0.01).cast("decimal(3,2)")
    capped = F.when(F.col("max_discount").isNull(), pct).otherwise(F.least(pct, F.col("max_discount")))
    raw = F.when(F.col("discount_type") == "percent", capped).otherwise(F.col("discount_value"))
    return raw.cast("decimal(10,0)")


def apply_voucher(orders: DataFrame, vouchers: DataFrame, *, as_of,
                  code_col: str = "voucher_code") -> DataFrame:
    """Per order and requested code: discount and total.

    A code counts when it names a usable voucher (case-insensitive) and the
    subtotal reaches min_order (NULL min_order rejects). Within the batch the
    uses left (max_uses − used_count) go to the earliest orders first; later
    ones get 0. Unknown or rejected codes give 0 and are kept on the order.
    """
    v = vouchers.select(F.col("voucher_id"), F.col("code").alias("_code"), "discount_type",
                        "discount_value", "max_discount", "min_order", "max_uses", "used_count",
                        "is_active", "expires_at")
    o = orders.withColumn("_req", F.upper(F.trim(F.col(code_col))))
    j = o.join(v, o._req == v._code, "left")
    valid = (F.col("voucher_id").isNotNull() & usable(as_of)
             & (F.col("subtotal") >= F.col("min_order")))
    j = j.withColumn("_valid", F.coalesce(valid, F.lit(False)))
    cand = j.filter(F.col("_valid"))
    # Rank valid orders per voucher by time (two-level: voucher, hour).
    ranked = prefix_sums(cand, ["voucher_id"], ["created_at", "order_id"], time_bucket("created_at"),
                         {}, seq="_rank")
    ranked = ranked.withColumn("_ok", F.col("max_uses").isNull()
                               | (F.col("_rank") <= F.col("max_uses") - F.col("used_count")))
    accepted = ranked.filter("_ok").select("order_id", voucher_discount(F.col("subtotal")).alias("discount"),
                                           F.col("voucher_id").alias("applied_voucher_id"))
    res = j.join(accepted, "order_id", "left")
    disc = F.coalesce(F.col("discount"), F.lit(0).cast("decimal(10,0)"))
    return res.select("order_id", F.col(code_col).alias("voucher_code"), "applied_voucher_id",
                      disc.alias("discount"),
                      (F.col("subtotal") - disc).cast("decimal(18,2)").alias("total"),
                      *[c for c in orders.columns if c not in ("order_id", code_col, "total")])


def loyalty_accrual(orders: DataFrame) -> DataFrame:
    """floor((subtotal − discount) / 10000) points; rows only when > 0 and the user is known."""
    pts = F.floor((F.col("subtotal") - F.col("discount_amount")) / F.lit(10000)).cast("bigint")
    return (orders.filter(F.col("user_id").isNotNull())
            .select("user_id", "order_id", pts.alias("points"))
            .filter(F.col("points") > 0))


def loyalty_balance(transactions: DataFrame) -> DataFrame:
    """Σ points per user and its value in VND (1 point = 1,000 VND; fixed value)."""
    return (transactions.groupBy("user_id").agg(F.sum("points").cast("bigint").alias("points"))
            .withColumn("value_vnd", F.col("points") * F.lit(1000)))


# Checkout columns that an order takes over from its request where the request has them.
CHECKOUT_COLS = ("order_type", "payment_method", "delivery_name", "delivery_phone", "delivery_address",
                 "delivery_timeslot", "notes")


def create_orders(order_requests: DataFrame, request_items: DataFrame, products: DataFrame,
                  vouchers: DataFrame, *, as_of, stage: str | None = None) -> dict[str, DataFrame]:
    """Batch order creation.

    With ``stage`` (a folder that all machines share, the caller's to remove)
    the priced items and the priced orders with their vouchers are written
    there once, and all frames read them; without it every frame computes
    what it needs, which is less for a single frame.

    ``order_requests``: (order_id, user_id, voucher_code, created_at, and any
    of ``CHECKOUT_COLS``); ``request_items``: (order_id, line_no,
    items_json). Order ids are given, so re-running the batch yields the same
    rows. Frames:

    * ``orders``, ``order_items``: priced orders and their item snapshots;
    * ``voucher_usages``: one row per order whose voucher was accepted, a
      discount of 0 included; ``voucher_counts``: used_count afterwards;
    * ``loyalty_transactions``, ``loyalty_points``: points per order, and
      the points to add per user;
    * ``notifications``: one kitchen notice per order;
    * ``rejects``: requests without any item that matches a product.
    """
    items = _staged(price_order_items(parse_order_items(request_items), products), stage, "items")
    sub = items.groupBy("order_id").agg(F.sum("line_subtotal").alias("subtotal"))
    asked = order_requests.join(sub, "order_id", "left")
    rejects = asked.filter(F.col("subtotal").isNull()).select(
        "order_id", "user_id", F.lit("no item matches a product").alias("reason"))
    priced = _staged(apply_voucher(asked.filter(F.col("subtotal").isNotNull()), vouchers, as_of=as_of), stage, "priced")
    orders = priced.select(
        "order_id", F.concat(F.lit("FF-"), F.col("order_id").cast("string")).alias("order_code"),
        "user_id", "voucher_code", "subtotal", F.col("discount").alias("discount_amount"),
        "total", F.lit("pending").alias("status"), "created_at",
        *[c for c in CHECKOUT_COLS if c in order_requests.columns])
    usages = priced.filter(F.col("applied_voucher_id").isNotNull()).select(
        F.col("applied_voucher_id").alias("voucher_id"), "order_id", "user_id",
        F.col("discount").alias("discount_amount"), F.col("created_at").alias("used_at"))
    uses = usages.groupBy("voucher_id").agg(F.count(F.lit(1)).alias("_uses"))
    counts = vouchers.join(uses, "voucher_id", "left").select(
        "voucher_id", "code", (F.col("used_count") + F.coalesce("_uses", F.lit(0))).alias("used_count"))
    loyalty = loyalty_accrual(orders).withColumn("reason", F.lit("order"))
    return {"orders": orders, "order_items": items.join(orders.select("order_id"), "order_id", "left_semi"),
            "voucher_usages": usages, "voucher_counts": counts, "loyalty_transactions": loyalty,
            "loyalty_points": loyalty.groupBy("user_id").agg(F.sum("points").cast("bigint").alias("points")),
            "notifications": order_notifications(orders), "rejects": rejects}


def _staged(df: DataFrame, stage: str | None, name: str) -> DataFrame:
    if stage is None:
        return df
    path = f"{stage.rstrip('/')}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def place_orders(store: VersionedTables, order_requests: DataFrame, request_items: DataFrame, products: DataFrame,
                 vouchers: DataFrame, *, as_of, batch_id: str) -> int:
    """``create_orders`` with all its frames in one commit; pricing and voucher ranks are computed once.

    Voucher counts replace the stored ones, the other frames are appended. A batch id counts once. Returns the
    version that holds the batch.
    """
    spark = order_requests.sparkSession
    held = store.manifest()
    if batch_id in held["batches"]:
        return held["batches"][batch_id]
    stage = f"{checkpoint_dir(spark).rstrip('/')}/orders-{uuid.uuid4().hex[:12]}"
    try:
        frames = create_orders(order_requests, request_items, products, vouchers, as_of=as_of, stage=stage)
        counts = frames.pop("voucher_counts")
        return store.commit(batch_id, append=frames, replace={"voucher_counts": counts}, base=held["version"])
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stage)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
