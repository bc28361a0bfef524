"""Voucher statistics, usage rates and eligibility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import lit_date, with_scalars
from .pricing import usable


def voucher_usage_rate(vouchers: DataFrame, *, as_of) -> DataFrame:
    """used / max_uses, hot when > 0.8 (fixed value), expired when expires_at < as_of."""
    rate = F.try_divide(F.col("used_count").cast("double"), F.nullif(F.col("max_uses").cast("double"), F.lit(0.0)))
    return vouchers.select("voucher_id", "code", rate.alias("rate"),
                           F.coalesce(rate > 0.8, F.lit(False)).alias("hot"),
                           F.coalesce(F.col("expires_at") < lit_date(as_of), F.lit(False)).alias("expired"))


def voucher_stats(vouchers: DataFrame, usages: DataFrame, *, as_of, month) -> DataFrame:
    """One row: usable vouchers at as_of, uses and discount given in ``month`` (YYYY-MM)."""
    lo = lit_date(f"{month}-01")
    hi = F.add_months(lo, 1)
    u = usages.filter((F.col("used_at") >= lo.cast("timestamp_ntz")) & (F.col("used_at") < hi.cast("timestamp_ntz")))
    a = vouchers.agg(F.count_if(usable(as_of)).alias("active_vouchers"))
    b = u.agg(F.count(F.lit(1)).alias("uses_in_month"), F.sum("discount_amount").alias("discount_given"))
    return with_scalars(a, b)


def voucher_redemption_rollup(vouchers: DataFrame, usages: DataFrame) -> DataFrame:
    """Uses per voucher counted from usage rows (0 when never used)."""
    c = usages.groupBy("voucher_id").agg(F.count(F.lit(1)).alias("used"))
    return (vouchers.select("voucher_id", "code").join(c, "voucher_id", "left")
            .select("voucher_id", "code", F.coalesce("used", F.lit(0)).alias("used")))


SALTS = 64


def voucher_eligibility(users: DataFrame, orders: DataFrame, active_subs: DataFrame,
                        vouchers: DataFrame, *, as_of) -> DataFrame:
    """(customer, voucher, scope) by the voucher's condition.

    all: every customer, as one row with ``user_id`` NULL and scope ``all``
    (customers x vouchers would emit all pairs); new_user / first_order: no
    earlier counting order (not cancelled, created before as_of);
    subscription: an active plan. Customers are tagged with the conditions
    they meet and joined to the usable vouchers on (condition, salt): three
    conditions alone would be three hot keys.
    """
    cust = users.filter(F.col("role") == "customer").select("user_id")
    before = orders.filter((F.col("status") != "cancelled")
                           & (F.col("created_at") < lit_date(as_of).cast("timestamp_ntz"))
                           & F.col("user_id").isNotNull()).select("user_id")
    fresh = cust.join(before, "user_id", "left_anti")
    subscribed = cust.join(active_subs.select("user_id"), "user_id", "left_semi")
    tags = (fresh.withColumn("cond", F.explode(F.array(F.lit("new_user"), F.lit("first_order"))))
            .unionByName(subscribed.withColumn("cond", F.lit("subscription"))))
    tags = tags.withColumn("salt", F.pmod(F.xxhash64("user_id"), F.lit(SALTS)))
    v = vouchers.filter(usable(as_of)).select("voucher_id", F.col("condition_type").alias("cond"))
    everyone = v.filter(F.col("cond") == "all").select(F.lit(None).cast("bigint").alias("user_id"), "voucher_id",
                                                       F.lit("all").alias("scope"))
    salted = v.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    own = tags.join(salted, ["cond", "salt"]).select("user_id", "voucher_id", F.lit("own").alias("scope"))
    return everyone.unionByName(own)


def condition_bitmaps(users: DataFrame, orders: DataFrame, active_subs: DataFrame, *, as_of) -> DataFrame:
    """(cond, bucket, bits): per voucher condition the customers that meet it, one bit each.

    A row covers 32,768 user ids (4 KiB), so the table's size follows the
    customers and not customers x vouchers, and each group is bounded.
    ``all`` holds every customer; the other conditions are those of
    ``voucher_eligibility``.
    """
    cust = users.filter(F.col("role") == "customer").select("user_id")
    before = orders.filter((F.col("status") != "cancelled")
                           & (F.col("created_at") < lit_date(as_of).cast("timestamp_ntz"))
                           & F.col("user_id").isNotNull()).select("user_id", F.lit(True).alias("ordered")).distinct()
    active = active_subs.select("user_id", F.lit(True).alias("subscribed")).distinct()
    tagged = cust.join(before, "user_id", "left").join(active, "user_id", "left")
    fresh = F.col("ordered").isNull()
    conds = F.array(F.lit("all"), F.when(fresh, "new_user"), F.when(fresh, "first_order"),
                    F.when(F.col("subscribed"), "subscription"))
    each = tagged.select("user_id", F.explode(F.array_compact(conds)).alias("cond"))
    return (each.groupBy("cond", F.bitmap_bucket_number("user_id").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("user_id")).alias("bits")))


def vouchers_of(asked: DataFrame, bitmaps: DataFrame, vouchers: DataFrame, *, as_of) -> DataFrame:
    """(user_id, voucher_id): the usable vouchers of the asked customers, expanded for these alone."""
    a = asked.select("user_id", F.bitmap_bucket_number("user_id").alias("bucket"),
                     F.bitmap_bit_position("user_id").alias("bit"))
    octet = F.conv(F.hex(F.substring("bits", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = (a.join(bitmaps, "bucket").where(F.getbit(octet, (F.col("bit") % 8).cast("int")) == 1)
           .select("user_id", "cond"))
    v = vouchers.filter(usable(as_of)).select("voucher_id", F.col("condition_type").alias("cond"))
    return met.join(v, "cond").select("user_id", "voucher_id")
