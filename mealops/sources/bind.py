"""Bindings: driver star-schema tables -> meal-ordering domain frames.

Each binding is a projection (plus at most one join) over a raw table, so
Catalyst pushes filters and prunes columns straight into the parquet scan of
the raw table. Frames are built lazily and memoised per ``Bound`` instance;
nothing is materialised here.

The rules are fixed so that an independent SQL rendering (the DuckDB oracle)
derives the same rows; see ``mealops.plans.oracle_bindings.BINDINGS``.
"""

from __future__ import annotations

import os
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import RAW

# Fixed reference dates of the bound data set.
STOCK_AS_OF = "2001-08-01"     # stock, vouchers, orders "today"
EVENTS_AS_OF = "2024-01-30"    # event-derived tables
MENU_WEEK = "1998-01-05"       # a Monday; menu schedule spine starts here

# The subscription plans of the seed data
# (name, weekly price, monthly price, meals per day, days per week).
PLAN_ROWS = [
    (1, "Starter Clean", 490000, 1750000, 1, 5, True),
    (2, "Full Day", 820000, 2950000, 2, 5, True),
    (3, "Total Wellness", 1150000, 4200000, 3, 7, True),
]

# Delivery time slots offered at checkout.
TIMESLOTS = ["07:00 - 09:00", "09:00 - 11:00", "11:00 - 13:00",
             "13:00 - 15:00", "15:00 - 17:00", "17:00 - 20:00"]

# Payment methods allowed by the orders table.
PAYMENT_METHODS = ["cod", "bank", "momo", "zalopay", "cash"]


def _d(s: str):
    return F.lit(s).cast("date")


def _dec(c, p, s):
    return c.cast(f"decimal({p},{s})")


class Bound:
    """Lazily bound domain frames over one directory of raw parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    # ------------------------------------------------------------------ raw
    def raw(self, name: str) -> DataFrame:
        path = os.path.join(self.sf_dir, f"{name}.parquet")
        return self.spark.read.schema(RAW[name]).parquet(path)

    # ------------------------------------------------------------ bindings
    @cached_property
    def users(self) -> DataFrame:
        c = self.raw("customer")
        k = F.col("c_custkey")
        return c.select(
            k.alias("user_id"),
            F.col("c_name").alias("full_name"),
            F.when(k % 50 == 0, "admin").when(k % 50 == 1, "kitchen")
             .otherwise("customer").alias("role"),
            (k % 7 != 0).alias("is_active"),
        )

    @cached_property
    def products(self) -> DataFrame:
        p = self.raw("part")
        size = F.col("p_size")
        return p.select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("name"),
            F.col("p_brand").alias("description"),
            F.col("p_type").alias("category"),
            F.concat(F.lit('["'), F.col("p_type"), F.lit('","'), F.col("p_brand"),
                     F.lit('"]')).alias("health_tags"),
            _dec(F.col("p_retailprice"), 18, 2).alias("price"),
            (F.lit(200) + F.lit(8) * size).alias("calories"),
            _dec(F.lit(10) + size % 40, 5, 1).alias("protein_g"),
            _dec(F.lit(5) + (size * 3) % 60, 5, 1).alias("carbs_g"),
            _dec(F.lit(2) + (size * 7) % 35, 5, 1).alias("fat_g"),
            (F.col("p_partkey") % 11 != 0).alias("is_available"),
        )

    @cached_property
    def categories(self) -> DataFrame:
        # One row per product type; slug is the lower-cased, dashed name.
        return (self.raw("part").select(F.col("p_type").alias("name")).distinct()
                .select("name", F.lower(F.regexp_replace("name", " ", "-")).alias("slug")))

    @cached_property
    def orders(self) -> DataFrame:
        o = self.raw("orders")
        key, cust = F.col("o_orderkey"), F.col("o_custkey")
        subtotal = _dec(F.col("o_totalprice"), 18, 2)
        discount = _dec(subtotal * _dec(F.lit(0.01), 3, 2) * _dec(key % 4, 1, 0), 18, 2)
        slots = F.array(*[F.lit(s) for s in TIMESLOTS])
        pays = F.array(*[F.lit(s) for s in PAYMENT_METHODS])
        return o.select(
            key.alias("order_id"),
            F.concat(F.lit("FF-"), key.cast("string")).alias("order_code"),
            F.when(cust % 20 == 0, F.lit(None)).otherwise(cust).alias("user_id"),
            F.when(F.col("o_orderpriority") == "5-LOW", "cancelled")
             .when(F.col("o_orderstatus") == "F", "done")
             .when(F.col("o_orderstatus") == "O", "pending")
             .otherwise("preparing").alias("status"),
            F.when(cust % 5 == 0, "walkin").otherwise("online").alias("order_type"),
            subtotal.alias("subtotal"),
            discount.alias("discount_amount"),
            _dec(subtotal - discount, 18, 2).alias("total"),
            F.element_at(slots, (key % 6 + 1).cast("int")).alias("delivery_timeslot"),
            F.element_at(pays, (key % 5 + 1).cast("int")).alias("payment_method"),
            F.col("o_orderdate").alias("created_at"),
        )

    @cached_property
    def order_items(self) -> DataFrame:
        li = self.raw("lineitem")
        p = self.products
        return li.join(p, li.l_partkey == p.product_id, "inner").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("line_no"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
            p.price.alias("unit_price"),
            _dec(F.col("l_extendedprice"), 18, 2).alias("subtotal"),
            p.calories.alias("calories_snapshot"),
            p.protein_g.alias("protein_snapshot"),
            p.carbs_g.alias("carbs_snapshot"),
            p.fat_g.alias("fat_snapshot"),
        )

    @cached_property
    def order_lines(self) -> DataFrame:
        """Order items without the product snapshots: one scan, no join."""
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"),
            F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("int").alias("quantity"),
            _dec(F.col("l_extendedprice"), 18, 2).alias("subtotal"))

    @cached_property
    def suppliers(self) -> DataFrame:
        s = self.raw("supplier")
        return s.select(
            F.col("s_suppkey").alias("supplier_id"),
            F.col("s_name").alias("name"),
            F.concat(F.lit("contact-"), F.col("s_nationkey").cast("string")).alias("contact_name"),
            F.col("s_nationkey").alias("category"),
            (F.col("s_acctbal") > 0).alias("is_active"),
        )

    @cached_property
    def shippers(self) -> DataFrame:
        s = self.raw("supplier")
        return s.select(
            F.col("s_suppkey").alias("shipper_id"),
            F.col("s_name").alias("full_name"),
            F.concat(F.lit("09"), F.col("s_suppkey").cast("string")).alias("phone"),
        )

    @cached_property
    def inventory(self) -> DataFrame:
        p = self.raw("part")
        k = F.col("p_partkey")
        expiry = F.date_add(_d(STOCK_AS_OF), (k % 12 - 3).cast("int"))
        return p.select(
            k.alias("inventory_id"),
            F.concat(F.lit("INV-"), k.cast("string")).alias("inventory_code"),
            F.when(k % 17 == 0, F.lit(None)).otherwise(k % 10).alias("supplier_id"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("category"),
            _dec(F.col("p_size") - 5, 10, 2).alias("quantity"),
            _dec(F.lit(10), 10, 2).alias("min_quantity"),
            _dec(F.col("p_retailprice"), 18, 2).alias("unit_price"),
            F.date_sub(expiry, (F.lit(5) + k % 10).cast("int")).alias("import_date"),
            expiry.alias("expiry_date"),
        )

    @cached_property
    def product_ingredients(self) -> DataFrame:
        # Ingredient ids wrap around the number of parts: a lazy scalar
        # subquery (answered from parquet metadata), not a driver-side count.
        part = self.raw("part")
        n = part.agg(F.count(F.lit(1))).scalar()
        p = part.select("p_partkey", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k"))
        return p.select(
            F.col("p_partkey").alias("product_id"),
            ((F.col("p_partkey") * 7 + F.col("k") * 13) % n).alias("inventory_id"),
            (_dec(F.lit(0.05), 3, 2) * _dec(F.col("k"), 1, 0)).alias("qty_per_portion"),
        )

    @cached_property
    def vouchers(self) -> DataFrame:
        n = self.raw("nation")
        k = F.col("n_nationkey")
        even = k % 2 == 0
        return n.select(
            k.cast("bigint").alias("voucher_id"),
            F.upper(F.col("n_name")).alias("code"),
            F.when(even, "percent").otherwise("fixed").alias("discount_type"),
            _dec(F.when(even, F.lit(5) * (F.lit(1) + k % 5))
                 .otherwise(F.lit(1000) * (F.lit(1) + k % 3)), 10, 2).alias("discount_value"),
            F.when(k % 3 == 0, F.lit(None)).otherwise(_dec(F.lit(20000), 10, 0))
             .cast("decimal(10,0)").alias("max_discount"),
            _dec(F.lit(50000) * (k % 4), 10, 0).alias("min_order"),
            F.when(k % 5 == 0, F.lit(None)).otherwise(F.lit(30)).alias("max_uses"),
            (k * 2).alias("used_count"),
            F.element_at(F.array(F.lit("all"), F.lit("new_user"), F.lit("first_order"),
                                 F.lit("subscription")), (k % 4 + 1).cast("int")).alias("condition_type"),
            F.when(k % 6 == 0, F.lit(None).cast("date"))
             .otherwise(F.date_add(_d(STOCK_AS_OF), (k - 8).cast("int"))).alias("expires_at"),
            (k % 8 != 7).alias("is_active"),
        )

    @cached_property
    def subscriptions(self) -> DataFrame:
        e = self.raw("events")
        eid = F.col("event_id")
        start = F.col("ts").cast("date")
        return e.filter(F.col("event_type") == "signup").select(
            eid.alias("subscription_id"),
            F.col("user_id"),
            (eid % 3 + 1).cast("int").alias("plan_id"),
            start.alias("start_date"),
            F.date_add(start, F.when(eid % 4 == 0, 30).otherwise(7)).alias("end_date"),
            F.when(eid % 5 == 0, "cancelled").when(eid % 5 == 1, "paused")
             .otherwise("active").alias("status"),
            F.when(eid % 4 == 0, "monthly").otherwise("weekly").alias("period"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def plans(self) -> DataFrame:
        return self.spark.createDataFrame(
            PLAN_ROWS,
            "plan_id int, name string, price_weekly int, price_monthly int, "
            "meals_per_day int, days_per_week int, is_active boolean",
        ).select("plan_id", "name",
                 F.col("price_weekly").cast("decimal(10,0)").alias("price_weekly"),
                 F.col("price_monthly").cast("decimal(10,0)").alias("price_monthly"),
                 "meals_per_day", "days_per_week", "is_active")

    @cached_property
    def inventory_logs(self) -> DataFrame:
        li = self.raw("lineitem")
        rf = F.col("l_returnflag")
        qty = _dec(F.col("l_quantity"), 10, 2)
        return li.select(
            F.col("l_partkey").alias("inventory_id"),
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("line_no"),
            F.when(rf == "R", "waste").when(rf == "A", "import").otherwise("export").alias("action_type"),
            F.when(rf == "A", qty).otherwise(-qty).alias("quantity_change"),
            F.col("l_shipdate").alias("created_at"),
        )

    @cached_property
    def status_events(self) -> DataFrame:
        e = self.raw("events")
        et = F.col("event_type")
        return e.select(
            "event_id",
            F.col("user_id").alias("order_id"),
            F.when(et == "signup", "pending").when(et == "view", "confirmed")
             .when(et == "click", "preparing").when(et == "purchase", "ready")
             .otherwise("cancelled").alias("status"),
            "ts",
        )

    @cached_property
    def pings(self) -> DataFrame:
        e = self.raw("events")
        eid = F.col("event_id")
        return e.select(
            "event_id",
            F.col("user_id").alias("order_id"),
            (eid % 10).alias("shipper_id"),
            _dec(F.lit(10) + _dec(F.col("value"), 10, 2) * _dec(F.lit(0.001), 4, 3), 10, 7).alias("latitude"),
            _dec(F.lit(106) + _dec(eid % 1000, 4, 0) * _dec(F.lit(0.0001), 5, 4), 10, 7).alias("longitude"),
            F.col("ts").alias("recorded_at"),
        )

    @cached_property
    def menu_schedule(self) -> DataFrame:
        p = self.raw("part")
        k = F.col("p_partkey")
        return p.select(
            k.alias("schedule_id"),
            F.date_add(_d(MENU_WEEK), (k % 28).cast("int")).alias("schedule_date"),
            k.alias("product_id"),
            F.when(k % 3 == 0, "breakfast").when(k % 3 == 1, "lunch").otherwise("dinner").alias("meal_type"),
            (F.lit(1) + F.col("p_size") % 5).alias("max_quantity"),
        )

    @cached_property
    def voucher_usages(self) -> DataFrame:
        o = self.orders
        return o.filter(F.col("discount_amount") > 0).select(
            F.col("order_id").alias("usage_id"),
            (F.col("order_id") % 25).alias("voucher_id"),
            "order_id", "user_id", "discount_amount",
            F.col("created_at").alias("used_at"),
        )

    @cached_property
    def notifications(self) -> DataFrame:
        e = self.raw("events")
        eid = F.col("event_id")
        by_role = eid % 3 == 0
        return e.select(
            eid.alias("notification_id"),
            F.when(by_role, F.when(eid % 2 == 0, "kitchen").otherwise("admin")).alias("target_role"),
            F.when(by_role, F.lit(None)).otherwise(F.col("user_id")).alias("user_id"),
            F.col("event_type").alias("type"),
            F.concat(F.lit("evt "), eid.cast("string")).alias("title"),
            (eid % 4 == 0).alias("is_read"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def logins(self) -> DataFrame:
        e = self.raw("events")
        return e.filter(F.col("event_type") == "signup").select("user_id", F.col("ts").alias("login_at"))

    @cached_property
    def cart_events(self) -> DataFrame:
        e = self.raw("events")
        eid, et = F.col("event_id"), F.col("event_type")
        return e.filter(et.isin("click", "error", "purchase")).select(
            "event_id",
            F.col("user_id"),
            (eid % 10).alias("product_id"),
            F.when(et == "click", "add").when(et == "error", "set").otherwise("clear").alias("action"),
            F.when(et == "click", F.lit(1) + eid % 3).when(et == "error", eid % 3 - 1)
             .cast("int").alias("qty"),
            F.when(et == "click", F.concat(F.lit("note "), eid.cast("string"))).alias("notes"),
            "ts",
        )

    @cached_property
    def requests(self) -> DataFrame:
        """Order requests as checkout sends them: an items array as JSON text.

        One request per line item, carrying the line's product and a side
        item from the line's supplier key (no notes, so ``notes`` is absent),
        plus an unlisted ``price`` field that parsing must drop.
        """
        li = self.raw("lineitem")
        s = lambda c: F.col(c).cast("string")
        txt = F.concat(F.lit('[{"product_id":'), s("l_partkey"),
                       F.lit(',"qty":'), F.col("l_quantity").cast("int").cast("string"),
                       F.lit(',"notes":"n'), s("l_linenumber"),
                       F.lit('","price":1.5},{"product_id":'), s("l_suppkey"),
                       F.lit(',"qty":1}]'))
        return li.select(F.col("l_orderkey").alias("order_id"),
                         F.col("l_linenumber").alias("line_no"), txt.alias("items_json"))

    @cached_property
    def subscribe_requests(self) -> DataFrame:
        e = self.raw("events")
        eid = F.col("event_id")
        return e.filter(F.col("event_type") == "purchase").select(
            eid.alias("request_id"), "user_id",
            F.when(eid % 4 == 0, "basic").when(eid % 4 == 1, "standard").when(eid % 4 == 2, "premium")
             .otherwise("gold").alias("plan"),
            F.when(eid % 2 == 0, "weekly").otherwise("monthly").alias("period"), "ts")

    @cached_property
    def lifecycle_events(self) -> DataFrame:
        e = self.raw("events")
        et = F.col("event_type")
        return e.filter(et.isin("view", "click", "error")).select(
            "event_id", "user_id",
            F.when(et == "view", "pause").when(et == "click", "renew").otherwise("cancel").alias("action"), "ts")

    @cached_property
    def voucher_requests(self) -> DataFrame:
        """Orders with a requested voucher code (lower-cased; every 7th order an unknown code)."""
        v = self.vouchers.select(F.col("voucher_id").alias("_vid"), "code")
        o = self.orders
        j = o.join(v, (o.order_id % 25) == v._vid, "left")
        code = F.when(o.order_id % 7 == 0, F.lit("nope")).otherwise(F.lower("code"))
        return j.select("order_id", "user_id", "subtotal", "created_at", code.alias("voucher_code"))

    @cached_property
    def order_requests(self) -> DataFrame:
        """Checkout requests: the voucher requests with the chosen type, payment and time slot."""
        o = self.orders.select("order_id", "order_type", "payment_method", "delivery_timeslot")
        return self.voucher_requests.drop("subtotal").join(o, "order_id")

    @cached_property
    def order_request_items(self) -> DataFrame:
        """Items of the requests; every 11th request names only products that do not exist."""
        r = self.requests
        gone = F.lit('[{"product_id":-1,"qty":1}]')
        return r.withColumn("items_json", F.when(F.col("order_id") % 11 == 0, gone).otherwise(F.col("items_json")))

    @cached_property
    def receipts(self) -> DataFrame:
        li = self.raw("lineitem")
        k = F.col("l_orderkey")
        # (order, line, part) names a line; the id packs the three.
        rid = (k * F.lit(10) + F.col("l_linenumber")) * F.lit(1_000_000) + F.col("l_partkey") % F.lit(1_000_000)
        return li.filter(F.col("l_returnflag") == "A").select(
            rid.alias("receipt_id"),
            F.when(k % 13 == 0, F.lit(None)).otherwise(
                F.concat(F.lit("item "), F.col("l_partkey").cast("string"))).alias("name"),
            _dec(F.col("l_quantity"), 10, 2).alias("quantity"),
            F.date_add(F.to_date("l_shipdate"), 30).alias("expiry_date"),
            (F.col("l_suppkey") % 10).alias("supplier_id"),
            _dec(F.col("l_extendedprice"), 18, 2).alias("unit_price"))

    @cached_property
    def voucher_feed(self) -> DataFrame:
        """A marketing feed: codes in mixed case with blanks, new, repeated and incomplete rows."""
        s = self.raw("supplier")
        k, n = F.col("s_suppkey"), F.col("s_suppkey") % 40
        names = self.vouchers.select(F.col("voucher_id").alias("_v"), F.col("code").alias("_c"))
        j = s.join(names, n == F.col("_v"), "left")
        code = F.when(k % 9 == 0, F.lit(None)).otherwise(F.concat(F.lit(" "), F.lower(F.coalesce(
            F.col("_c"), F.concat(F.lit("new"), n.cast("string")))), F.lit(" ")))
        return j.select(code.alias("code"),
                        F.when(k % 7 == 0, F.lit(None)).when(k % 2 == 0, "percent").otherwise("fixed").alias("discount_type"),
                        _dec(F.lit(5) + k % 20, 10, 2).alias("discount_value"),
                        F.lit(None).cast("decimal(10,0)").alias("min_order"), k.alias("seq"))

    @cached_property
    def supplier_feed(self) -> DataFrame:
        """A supplier feed from customers: known ids are renamed, new ids are added, some lack a name."""
        c = self.raw("customer")
        k = F.col("c_custkey")
        return c.select((k % 150).alias("supplier_id"),
                        F.when(k % 13 == 0, F.lit(None)).otherwise(F.concat(F.lit("supplier "), k.cast("string"))).alias("name"),
                        F.when(k % 2 == 0, F.lit(None)).otherwise(F.concat(F.lit("new contact "), k.cast("string")))
                        .alias("contact_name"), k.alias("seq"))

    @cached_property
    def checked(self) -> dict[str, DataFrame]:
        """Frames for the constraint checks, with rows that break the rules."""
        o, u, v, s = self.orders, self.users, self.vouchers, self.subscriptions
        oid, uid, vid = F.col("order_id"), F.col("user_id"), F.col("voucher_id")
        aid, tid = F.col("address_id"), F.col("txn_id")
        lines = self.order_lines.withColumn("product_id", F.when(F.col("line_no") == 7, F.col("product_id") + 100000000)
                                            .otherwise(F.col("product_id")))
        return {
            "users": u.withColumn("full_name", F.when(uid % 41 == 0, F.lit(None)).otherwise(F.col("full_name")))
                      .withColumn("role", F.when(uid % 43 == 0, "guest").otherwise(F.col("role")))
                      .withColumn("email", F.concat(F.lit("u"), F.when(uid % 37 == 0, F.lit(0)).otherwise(uid).cast("string"),
                                                    F.lit("@mail.test"))),
            "products": self.products, "categories": self.categories, "plans": self.plans, "suppliers": self.suppliers,
            "shippers": self.shippers, "menu_schedule": self.menu_schedule, "inventory_logs": self.inventory_logs,
            "orders": o.withColumn("payment_method", F.when(oid % 97 == 0, "card").otherwise(F.col("payment_method")))
                       .withColumn("payment_status", F.when(oid % 89 == 0, "lost").when(oid % 3 == 0, "paid")
                                   .when(oid % 7 == 0, "refunded").otherwise("pending"))
                       .withColumn("user_id", F.when(oid % 83 == 0, uid + 100000000).otherwise(uid)),
            "order_items": lines, "inventory": self.inventory, "product_ingredients": self.product_ingredients,
            "vouchers": v.withColumn("code", F.when(vid % 11 == 0, "TWICE").otherwise(F.col("code"))),
            "voucher_usages": self.voucher_usages.withColumn(
                "voucher_id", F.when(F.col("usage_id") % 79 == 0, F.lit(99).cast("bigint")).otherwise(vid)),
            "subscriptions": s.withColumn("plan_id", F.when(F.col("subscription_id") % 71 == 0, F.lit(9)).otherwise(F.col("plan_id"))),
            "pings": self.pings, "notifications": self.notifications,
            "delivery_addresses": self.delivery_addresses.withColumn(
                "user_id", F.when(aid % 61 == 0, F.lit(None)).when(aid % 67 == 0, uid + 100000000).otherwise(uid))
            .withColumn("address", F.when(aid % 59 == 0, F.lit(None)).otherwise(F.col("address"))),
            "loyalty_transactions": self.loyalty_transactions.withColumn(
                "user_id", F.when(tid % 101 == 0, uid + 100000000).otherwise(uid))
            .withColumn("order_id", F.when(tid % 103 == 0, oid + 100000000).otherwise(oid))
            .withColumn("points_change", F.when(tid % 73 == 0, F.lit(None)).otherwise(F.col("points_change"))),
        }

    @cached_property
    def adjustments(self) -> DataFrame:
        e = self.raw("events")
        return e.filter(F.col("event_type") == "view").select(
            "event_id", F.concat(F.lit("INV-"), F.col("user_id").cast("string")).alias("inventory_code"),
            _dec(F.col("value"), 10, 2).alias("quantity"), F.lit("stock count").alias("reason"), "ts")

    @cached_property
    def product_feed(self) -> DataFrame:
        li = self.raw("lineitem")
        ln, pk = F.col("l_linenumber"), F.col("l_partkey")
        return li.select(
            F.when(ln == 7, pk + F.lit(100000000)).otherwise(pk).alias("product_id"),
            F.when(ln == 6, F.lit(None)).otherwise(F.concat(F.lit("feed "), pk.cast("string"))).alias("name"),
            _dec(F.col("l_extendedprice"), 18, 2).alias("price"),
            F.lit(None).cast("int").alias("calories"),
            F.col("l_shipdate").alias("ts"), F.col("l_orderkey").alias("seq1"), ln.alias("seq2"))

    @cached_property
    def delivery_addresses(self) -> DataFrame:
        # One default address per customer; every fourth has a second one.
        c = self.raw("customer")
        k = F.col("c_custkey")
        nth = F.explode(F.when(k % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("nth")
        return c.select(k.alias("user_id"), F.col("c_nationkey").cast("string").alias("nation"), nth).select(
            (F.col("user_id") * 2 + F.col("nth")).alias("address_id"),
            "user_id",
            F.when(F.col("nth") == 0, "home").otherwise("office").alias("label"),
            F.concat(F.lit("nation "), F.col("nation")).alias("address"),
            (F.col("nth") == 0).alias("is_default"),
        )

    @cached_property
    def loyalty_transactions(self) -> DataFrame:
        # One accrual per order of a known user that earns a point (pricing.loyalty_accrual).
        pts = F.floor((F.col("subtotal") - F.col("discount_amount")) / F.lit(10000)).cast("int")
        return (self.orders.filter(F.col("user_id").isNotNull())
                .select(F.col("order_id").alias("txn_id"), "user_id", "order_id", pts.alias("points_change"),
                        F.lit("order").alias("reason"), "created_at")
                .filter(F.col("points_change") > 0))

    def frames(self) -> dict[str, DataFrame]:
        names = ["users", "categories", "products", "subscription_plans", "subscriptions",
                 "orders", "order_items", "suppliers", "inventory", "product_ingredients",
                 "inventory_logs", "menu_schedule", "vouchers", "voucher_usages", "shippers",
                 "shipper_tracking", "notifications"]
        alias = {"subscription_plans": "plans", "shipper_tracking": "pings"}
        return {n: getattr(self, alias.get(n, n)) for n in names}
