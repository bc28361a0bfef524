"""The constraint checks cover every table that has a constraint, with the data model's own domains."""

import datetime as dt

import pytest

from mealops.operators import quality
from mealops.plans.queries_io import KEY_COLS
from mealops.sources.bind import Bound
from support import SMALL, rows

TABLES = {"delivery_addresses", "loyalty_transactions", "notifications"}


def test_payment_status_domain(spark):
    """A refund is a payment status, a failure is none."""
    f = spark.createDataFrame([(1, "refunded"), (2, "failed"), (3, None)], "order_id long, payment_status string")
    out = quality.union_all(quality.row_rules({"orders": f}, {"orders": ["order_id"]}))
    assert ("orders", "check_payment_status", "2") in rows(out, "table_name", "rule", "key")
    assert out.where("rule = 'check_payment_status'").count() == 1


def test_addresses_points_and_notices(spark):
    day = dt.datetime(2001, 1, 1)
    frames = {
        "users": spark.createDataFrame([(5, "e", "u", "customer", True)],
                                       "user_id long, email string, full_name string, role string, is_active boolean"),
        "orders": spark.createDataFrame([(1,)], "order_id long"),
        "delivery_addresses": spark.createDataFrame(
            [(1, 5, "a"), (2, 6, "a"), (3, None, "a"), (4, 5, None)], "address_id long, user_id long, address string"),
        "loyalty_transactions": spark.createDataFrame(
            [(1, 5, 1, 3), (2, 5, None, -3), (3, 6, 1, 1), (4, 5, 2, 1), (5, 5, 1, None)],
            "txn_id long, user_id long, order_id long, points_change int"),
        "notifications": spark.createDataFrame(
            [(1, 5, day), (2, None, day), (3, 7, day)], "notification_id long, user_id long, created_at timestamp"),
    }
    out = quality.validate_constraints(frames, KEY_COLS)
    assert rows(out.where(out["table_name"].isin(*TABLES)), "table_name", "rule", "key") == [
        ("delivery_addresses", "fk_user_id_users", "2"), ("delivery_addresses", "not_null_address", "4"),
        ("delivery_addresses", "not_null_user_id", "3"),
        ("loyalty_transactions", "fk_order_id_orders", "4"), ("loyalty_transactions", "fk_user_id_users", "3"),
        ("loyalty_transactions", "not_null_points_change", "5"),
        ("notifications", "fk_user_id_users", "3")]


@pytest.fixture(scope="module")
def checked(spark):
    return Bound(spark, SMALL).checked


def test_every_rule_meets_its_columns(checked):
    """No rule of the query is skipped for a missing table or column."""
    for t, cols in quality.NOT_NULL.items():
        assert set(cols) <= set(checked[t].columns), t
    for t, c in quality.DOMAINS:
        assert c in checked[t].columns, (t, c)
    for t, groups in quality.UNIQUE.items():
        assert all(set(g) <= set(checked[t].columns) for g in groups), t
    for child, ccols, parent, pcols, kcols in quality.FOREIGN_KEYS:
        assert {*ccols, *kcols} <= set(checked[child].columns) and set(pcols) <= set(checked[parent].columns), child
    assert set(quality.NOT_NULL) | {fk[0] for fk in quality.FOREIGN_KEYS} <= set(KEY_COLS)
