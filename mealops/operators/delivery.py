"""Delivery tracking and the notification feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_position(pings: DataFrame, shippers: DataFrame) -> DataFrame:
    """Newest ping per order (max_by, ties by event id) with the shipper's name and phone."""
    last = pings.groupBy("order_id").agg(F.max_by(
        F.struct("latitude", "longitude", "recorded_at", "shipper_id"),
        F.struct("recorded_at", "event_id")).alias("p"))
    s = shippers.select("shipper_id", F.col("full_name").alias("shipper_name"), "phone")
    return (last.select("order_id", "p.*").join(s, "shipper_id")
            .select("order_id", "latitude", "longitude", "recorded_at", "shipper_id", "shipper_name", "phone"))


def notification_feed(notifications: DataFrame, users: DataFrame, k: int = 20) -> DataFrame:
    """Newest ``k`` notifications per user (own or addressed to the user's role).

    The OR join is split into two equi-joins. Role notices are cut to the
    newest k per role *before* they meet the users (the final top k can only
    use those), so the fan-out is k per user, never role size × users. Rows
    that are repeated take one of the k places. The unread count is taken
    within the k shown.
    """
    cols = ["notification_id", "type", "title", "is_read", "created_at"]
    order = [F.col("created_at").desc(), F.col("notification_id").desc()]
    own = (notifications.filter(F.col("user_id").isNotNull())
           .select("user_id", *cols))
    w_role = Window.partitionBy("target_role").orderBy(*order)
    role_top = (notifications.filter(F.col("target_role").isNotNull())
                .withColumn("_r", F.dense_rank().over(w_role)).filter(F.col("_r") <= k)
                .select(F.col("target_role").alias("role"), *cols).dropDuplicates(["role", "notification_id"]))
    # role_top holds at most k rows per role (a CHECK domain of three values):
    # a proven bound, so it is broadcast and the few roles never become hot
    # shuffle keys.
    by_role = users.select("user_id", "role").join(F.broadcast(role_top), "role").drop("role")
    # Own notices are cut to the newest k per user before the shuffle (a top-k window), so at
    # most 2k notices per user remain to be merged and de-duplicated. Copies of a row share a place.
    w = Window.partitionBy("user_id").orderBy(*order)
    own = own.withColumn("_r", F.dense_rank().over(w)).filter(F.col("_r") <= k).drop("_r")
    both = own.unionByName(by_role).dropDuplicates(["user_id", "notification_id"])
    top = both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    unread = top.groupBy("user_id").agg(F.count_if(~F.col("is_read")).alias("unread"))
    return top.join(unread, "user_id")
