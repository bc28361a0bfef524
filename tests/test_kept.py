"""Daily sums kept from changes, duration sketches, condition bitmaps."""

import datetime as dt
import random
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from support import rows

from mealops.operators import orders, promo
from mealops.streaming import streams as S
from test_stream_state import _feed

D0 = dt.date(2024, 1, 1)


def _versions(seed):
    """Versions of 40 orders: days, totals and states move, some are cancelled and some come back."""
    rng, out = random.Random(seed), []
    for o in range(40):
        for v in range(rng.randint(1, 5)):
            out.append((o, v, D0 + dt.timedelta(days=rng.randint(0, 4)), rng.choice(("pending", "done", "cancelled")),
                        Decimal(rng.randint(1, 999)), Decimal(rng.randint(0, 9))))
    rng.shuffle(out)
    return out


def _recomputed(versions):
    last, days = {}, {}
    for r in sorted(versions, key=lambda r: r[1]):
        last[r[0]] = r
    for _, _, day, status, total, discount in last.values():
        if status != "cancelled":
            n, t, d = days.get(day, (0, 0, 0))
            days[day] = (n + 1, t + total, d + discount)
    return sorted((day, *x) for day, x in days.items())


@pytest.mark.parametrize("seed", [1, 2])
def test_kept_revenue_equals_recomputation(spark, seed):
    data = _versions(seed)
    cuts = [0, 20, 21, 60, len(data)]
    batches = [data[a:b] + data[a:a + 3] for a, b in zip(cuts, cuts[1:])] + [data[:10]]       # repeats, and a replay
    base = tempfile.mkdtemp(prefix="mealops-kept-")
    stream = _feed(spark, f"{base}/in", batches, S.KEPT_ORDER)
    S.kept_revenue_stream(stream, f"{base}/state", f"{base}/ck", compact_every=2).awaitTermination()
    assert rows(S.kept_revenue(spark, f"{base}/state", compact_every=2)) == _recomputed(data)
    last = spark.read.parquet(f"{base}/state/orders/batch_id=4")
    assert last.count() == 0                                          # the replay changed nothing


def test_kept_revenue_of_nothing(spark):
    assert S.kept_revenue(spark, tempfile.mkdtemp() + "/none").count() == 0


def _events(n):
    rng, out, t0 = random.Random(5), [], dt.datetime(2024, 1, 1)
    for o in range(n):
        t = t0 + dt.timedelta(minutes=rng.randint(0, 10 * 1440))
        for status in ("pending", "confirmed", "preparing", "ready"):
            out.append((len(out), o, status, t))
            t += dt.timedelta(seconds=int(rng.expovariate(1 / 900)))
    return out


def test_duration_sketches_merge_over_days(spark):
    ev = spark.createDataFrame(_events(4000), "event_id long, order_id long, status string, ts timestamp_ntz")
    steps = orders.stage_steps(ev)
    sketches = orders.duration_sketches(steps)
    assert rows(sketches.groupBy("step").agg(F.sum("n").alias("n"))) == rows(steps.groupBy("step").agg(F.count("*").alias("n")))
    for lo, hi in (("2024-01-01", "2024-01-12"), ("2024-01-03", "2024-01-03"), ("2024-01-02", "2024-01-07")):
        span = {"date_from": lo, "date_to": hi}
        found = orders.duration_percentiles(sketches, **span, probs=(0.05, 0.5, 0.95))
        checked = orders.rank_checked(found, steps, **span, error=0.02).collect()
        assert len(checked) == 9 and all(r.within for r in checked)
        wrong = orders.rank_checked(found.withColumn("minutes", F.col("minutes") * 1.5), steps, **span, error=0.02)
        assert not any(r.within for r in wrong.where("p = 0.5").collect())
    assert orders.duration_percentiles(sketches, date_from="2023-01-01", date_to="2023-01-02").count() == 0
    # Sketches of the orders' halves merge to the same answer within the error.
    halves = orders.duration_sketches(steps.where("order_id % 2 = 0")).unionByName(
        orders.duration_sketches(steps.where("order_id % 2 = 1")))
    span = {"date_from": "2024-01-01", "date_to": "2024-01-12"}
    assert all(r.within for r in orders.rank_checked(orders.duration_percentiles(halves, **span), steps, **span, error=0.02).collect())


def test_bitmaps_give_the_pairs_of_asked_customers(spark, bound):
    from mealops.operators import subs
    as_of = "2001-08-01"
    active = subs.active_subscriptions_as_of(bound.subscriptions, as_of=as_of)
    bitmaps = promo.condition_bitmaps(bound.users, bound.orders, active, as_of=as_of)
    whole = promo.voucher_eligibility(bound.users, bound.orders, active, bound.vouchers, as_of=as_of)
    everyone = whole.where("scope = 'all'").select("voucher_id")
    cust = bound.users.where("role = 'customer'").select("user_id")
    exp = whole.where("scope = 'own'").select("user_id", "voucher_id").unionByName(cust.crossJoin(everyone))
    got = promo.vouchers_of(bound.users.select("user_id"), bitmaps, bound.vouchers, as_of=as_of)
    assert rows(got) == rows(exp) and got.count() > 0
    one = bound.users.where("user_id = 3").select("user_id")
    assert rows(promo.vouchers_of(one, bitmaps, bound.vouchers, as_of=as_of)) == rows(exp.where("user_id = 3"))
    assert bitmaps.count() <= 4 * (1 + cust.count() // 32_768 + 1)


def test_bitmaps_over_bucket_borders(spark):
    ids = [1, 7, 8, 9, 32_767, 32_768, 32_769, 65_536, 100_000]
    users = spark.createDataFrame([(i, "customer") for i in ids] + [(5, "admin")], "user_id long, role string")
    none = spark.createDataFrame([], "user_id long, status string, created_at timestamp_ntz")
    bitmaps = promo.condition_bitmaps(users, none, none.select("user_id"), as_of="2024-01-01")
    vouchers = spark.createDataFrame([(1, "first_order", True, None, None, 0)],
                                     "voucher_id long, condition_type string, is_active boolean, expires_at timestamp_ntz, "
                                     "max_uses int, used_count int")
    asked = spark.createDataFrame([(i,) for i in [*ids, 2, 5, 10, 32_766, 65_537]], "user_id long")
    assert [r[0] for r in rows(promo.vouchers_of(asked, bitmaps, vouchers, as_of="2024-01-01"))] == ids
