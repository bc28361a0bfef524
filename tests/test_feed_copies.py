"""Repeated notices take one place in the feed."""

import datetime as dt

from support import rows
from mealops.operators.delivery import notification_feed

NOTICES = "notification_id long, target_role string, user_id long, type string, title string, is_read boolean, created_at timestamp_ntz"


def _feed(spark, to_role: bool):
    t0 = dt.datetime(2024, 1, 1)
    notices = [(i, "customer" if to_role else None, None if to_role else 7, "info", f"n {i}", i % 2 == 0,
                t0 + dt.timedelta(hours=i)) for i in range(6)]
    users = spark.createDataFrame([(7, "customer")], "user_id long, role string")
    return rows(notification_feed(spark.createDataFrame(notices + [notices[-1]] * 19, NOTICES), users, k=4),
                "rank", "notification_id", "unread")


def test_copies_of_an_own_notice_share_one_place(spark):
    assert _feed(spark, False) == [(1, 5, 2), (2, 4, 2), (3, 3, 2), (4, 2, 2)]


def test_copies_of_a_role_notice_share_one_place(spark):
    assert _feed(spark, True) == [(1, 5, 2), (2, 4, 2), (3, 3, 2), (4, 2, 2)]
