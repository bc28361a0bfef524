"""Subscription plans, active sets, reports and lifecycle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import lit_date
from ..functions.windows import last_non_null, time_bucket

# Plan aliases accepted by the subscribe request (unknown -> 1).
PLAN_ALIASES = {"basic": 1, "standard": 2, "premium": 3}


def active_plans(plans: DataFrame) -> DataFrame:
    return plans.filter("is_active").select("plan_id", "name")


def active_subscriptions_as_of(subs: DataFrame, *, as_of) -> DataFrame:
    """status = active AND as_of BETWEEN start_date AND end_date (inclusive)."""
    d = lit_date(as_of)
    return subs.filter((F.col("status") == "active") & d.between(F.col("start_date"), F.col("end_date")))


def active_subscription_per_user(subs: DataFrame, plans: DataFrame) -> DataFrame:
    """Newest active subscription per user, with the plan name (max_by, no sort)."""
    a = subs.filter(F.col("status") == "active").groupBy("user_id").agg(
        F.max_by(F.struct("subscription_id", "plan_id"), F.struct("created_at", "subscription_id")).alias("s"))
    p = plans.select("plan_id", F.col("name").alias("plan_name"))
    return (a.select("user_id", F.col("s.subscription_id").alias("subscription_id"), F.col("s.plan_id").alias("plan_id"))
            .join(F.broadcast(p), "plan_id").select("user_id", "subscription_id", "plan_name"))


def subscription_report(subs: DataFrame, plans: DataFrame, *, month) -> DataFrame:
    """Per plan for a month (``YYYY-MM``): active, new, cancelled, retention %, revenue.

    active: status active and the subscription overlaps the month; new:
    started in the month; cancelled: cancelled and started in the month;
    retention = (active − cancelled) / active × 100; revenue = active × weekly price.
    """
    lo = lit_date(f"{month}-01")
    hi = F.add_months(lo, 1)
    started = (F.col("start_date") >= lo) & (F.col("start_date") < hi)
    g = subs.groupBy("plan_id").agg(
        F.count_if((F.col("status") == "active") & (F.col("start_date") < hi) & (F.col("end_date") >= lo)).alias("active"),
        F.count_if(started).alias("new"),
        F.count_if(started & (F.col("status") == "cancelled")).alias("cancelled"))
    j = g.join(F.broadcast(plans.select("plan_id", "price_weekly")), "plan_id")
    return j.select("plan_id", "active", "new", "cancelled",
                    F.try_divide((F.col("active") - F.col("cancelled")) * 100.0,
                                 F.nullif(F.col("active").cast("double"), F.lit(0.0))).alias("retention"),
                    (F.col("active") * F.col("price_weekly")).alias("revenue"))


def subscribe_batch(subs: DataFrame, requests: DataFrame, plans: DataFrame) -> DataFrame:
    """Apply a batch of subscribe requests; return the subscriptions afterwards.

    ``requests``: (request_id, user_id, plan, period, ts). Each new
    subscription runs 7 (weekly) or 30 days from the request day at the
    plan's weekly or monthly price; unknown plan aliases mean plan 1. A user's
    latest request stays active; the user's earlier active rows (existing or
    from the same batch) are cancelled.
    """
    alias = F.create_map(*[x for k, v in PLAN_ALIASES.items() for x in (F.lit(k), F.lit(v))])
    p = plans.select("plan_id", "price_weekly", "price_monthly")
    r = (requests.withColumn("plan_id", F.coalesce(alias[F.col("plan")], F.lit(1)))
         .join(F.broadcast(p), "plan_id"))
    start = F.to_date("ts")
    weekly = F.col("period") == "weekly"
    last = requests.groupBy("user_id").agg(F.max_by("request_id", F.struct("ts", "request_id")).alias("_last"))
    new = r.join(last, "user_id").select(
        F.col("request_id").alias("subscription_id"), "user_id", "plan_id",
        start.alias("start_date"),
        F.date_add(start, F.when(weekly, 7).otherwise(30)).alias("end_date"),
        F.when(F.col("request_id") == F.col("_last"), "active").otherwise("cancelled").alias("status"),
        F.when(weekly, "weekly").otherwise("monthly").alias("period"),
        F.when(weekly, F.col("price_weekly")).otherwise(F.col("price_monthly")).alias("price"),
        F.col("ts").alias("created_at"))
    users = last.select("user_id", F.lit(True).alias("_req"))
    old = subs.join(users, "user_id", "left").withColumn(
        "status", F.when(F.col("_req") & (F.col("status") == "active"), "cancelled").otherwise(F.col("status")))
    old = old.select("subscription_id", "user_id", "plan_id", "start_date", "end_date", "status", "period",
                     F.lit(None).cast("decimal(10,0)").alias("price"), "created_at")
    return old.unionByName(new)


# Fixed values (our mapping of page actions to statuses).
LIFECYCLE = {"pause": "paused", "renew": "active", "cancel": "cancelled"}


def subscription_lifecycle(subs: DataFrame, events: DataFrame, *, as_of) -> DataFrame:
    """Status after pause/renew/cancel events; active past end_date -> expired.

    ``events``: (event_id, user_id, action, ts). An event applies to the
    user's latest subscription created at or before it (an as-of match done
    as a forward fill over the merged, time-ordered rows, split by hour).
    """
    # At one time a subscription comes before events, whatever the ids.
    s_rows = subs.select("user_id", F.col("created_at").alias("ts"), F.lit(0).alias("kind"),
                         F.col("subscription_id").alias("id"),
                         F.col("subscription_id").alias("sid"), F.lit(None).cast("string").alias("action"))
    e_rows = events.select("user_id", "ts", F.lit(1).alias("kind"), F.col("event_id").alias("id"), F.lit(None).cast("bigint").alias("sid"),
                           "action")
    merged = s_rows.unionByName(e_rows)
    ff = last_non_null(merged, ["user_id"], ["ts", "kind", "id"], time_bucket("ts"), "sid", "target")
    applied = ff.filter(F.col("action").isNotNull() & F.col("target").isNotNull())
    m = F.create_map(*[x for k, v in LIFECYCLE.items() for x in (F.lit(k), F.lit(v))])
    latest = applied.groupBy(F.col("target").alias("subscription_id")).agg(
        F.max_by(m[F.col("action")], F.struct("ts", "id")).alias("new_status"))
    j = subs.join(latest, "subscription_id", "left")
    st = F.coalesce("new_status", "status")
    st = F.when((st == "active") & (F.col("end_date") < lit_date(as_of)), "expired").otherwise(st)
    return j.select("subscription_id", "user_id", "plan_id", "start_date", "end_date", st.alias("status"))
