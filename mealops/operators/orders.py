"""Order listings, summaries, pricing of requests and the status log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import dbl, lit_date, ntz_micros, status_rank
from ..functions.windows import previous_values, time_bucket

STAFF_ROLES = ("admin", "kitchen")


def clamp_limit(limit) -> int:
    """``min(max(parseInt(limit) || 50, 1), 200)``: the leading integer of the
    text counts; non-numeric or 0 gives 50."""
    import re
    m = re.match(r"\s*([+-]?\d+)", "" if limit is None else str(limit))
    n = int(m.group(1)) if m else 0
    return min(max(n or 50, 1), 200)


def parse_status_list(statuses: str | None) -> list[str]:
    """Comma list -> trimmed, non-empty statuses."""
    if not statuses:
        return []
    return [s.strip() for s in statuses.split(",") if s.strip()]


def row_scope_by_role(orders: DataFrame, viewers: DataFrame) -> DataFrame:
    """Which orders each viewer may see.

    Staff see every order: they get one row with ``order_id`` NULL and
    scope ``all`` (expanding staff x orders would emit all pairs). Customers
    get one row per own order (an equi-join on user_id).
    """
    staff = (viewers.filter(F.col("role").isin(*STAFF_ROLES))
             .select(F.col("user_id").alias("viewer_id"), "role",
                     F.lit(None).cast("bigint").alias("order_id"), F.lit("all").alias("scope")))
    own = (viewers.filter(~F.col("role").isin(*STAFF_ROLES))
           .join(orders.select(F.col("user_id").alias("viewer_id"), "order_id"),
                 F.col("user_id") == F.col("viewer_id"))
           .select("viewer_id", "role", "order_id", F.lit("own").alias("scope")))
    return staff.unionByName(own)


def scope_predicate(role: str, user_id) -> Column:
    """The same rule as a predicate for one viewer (``user_id``: a value or a scalar subquery)."""
    if role in STAFF_ROLES:
        return F.lit(True)
    return F.col("user_id") == (user_id if isinstance(user_id, Column) else F.lit(user_id))


def orders_listing(orders: DataFrame, users: DataFrame, *, role: str, user_id=None,
                   statuses: str | None = None, order_type: str | None = None,
                   limit=50) -> DataFrame:
    """Newest-first order list for one viewer (top-k by created_at, order_id)."""
    o = orders.filter(scope_predicate(role, user_id))
    st = parse_status_list(statuses)
    if st:
        o = o.filter(F.col("status").isin(*st))
    if order_type:
        o = o.filter(F.col("order_type") == order_type)
    u = users.select(F.col("user_id").alias("_uid"), F.col("full_name").alias("customer_name"))
    top = (o.select("order_id", "user_id", "status", "order_type", "subtotal", "total", "created_at")
           .orderBy(F.col("created_at").desc(), F.col("order_id").desc())
           .limit(clamp_limit(limit)))
    # Join the names after the top-k: only `limit` rows reach the join.
    return (top.join(u, top.user_id == u._uid, "left")
            .select("order_id", "status", "order_type", dbl("subtotal").alias("subtotal"),
                    dbl("total").alias("total"), "created_at", "customer_name"))


def item_counts(order_items: DataFrame) -> DataFrame:
    """One row per order: number of item rows and total calories."""
    return order_items.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("item_count"),
        F.sum(F.col("quantity").cast("bigint") * F.col("calories_snapshot")).alias("total_calories"))


def my_orders(orders: DataFrame, order_items: DataFrame) -> DataFrame:
    """Each known user's orders with item_count (0 when the order has no items)."""
    ic = order_items.groupBy("order_id").agg(F.count(F.lit(1)).alias("item_count"))
    o = orders.filter(F.col("user_id").isNotNull())
    return (o.join(ic, "order_id", "left")
            .select("user_id", "order_id", "status", dbl("total").alias("total"),
                    F.coalesce("item_count", F.lit(0)).alias("item_count"), "created_at"))


def orders_by_status(orders: DataFrame, status: str | None = None) -> DataFrame:
    o = orders if not status or status == "all" else orders.filter(F.col("status") == status)
    return o.select("order_id", "status")


def current_delivering_order(orders: DataFrame, status: str = "delivering") -> DataFrame:
    """Per user, the newest order in ``status`` (max_by: no sort, partial agg)."""
    o = orders.filter((F.col("status") == status) & F.col("user_id").isNotNull())
    return o.groupBy("user_id").agg(
        F.max_by("order_id", F.struct("created_at", "order_id")).alias("order_id"))


def order_summary(orders: DataFrame, users: DataFrame, order_items: DataFrame) -> DataFrame:
    """Per order: customer name, total, item_count (0 if none), total_calories (NULL if none).

    One aggregate over items (instead of two correlated subqueries), then two
    left joins on keys.
    """
    ic = item_counts(order_items)
    u = users.select(F.col("user_id").alias("_uid"), F.col("full_name").alias("customer_name"))
    o = orders.select("order_id", "user_id", "total")
    return (o.join(ic, "order_id", "left").join(u, o.user_id == u._uid, "left")
            .select("order_id", "customer_name", dbl("total").alias("total"),
                    F.coalesce("item_count", F.lit(0)).alias("item_count"),
                    "total_calories"))


def price_order_items(items: DataFrame, products: DataFrame) -> DataFrame:
    """Parsed request items x products: price and macro snapshots.

    Unknown product ids drop out (inner join), as in the reference insert.
    """
    p = products.select(F.col("product_id").alias("_pid"), "price", "calories",
                        "protein_g", "carbs_g", "fat_g")
    j = items.join(p, items.product_id == p._pid, "inner")
    return j.select(
        *[c for c in items.columns],
        F.col("price").alias("unit_price"),
        (F.col("price") * F.col("qty")).cast("decimal(18,2)").alias("line_subtotal"),
        F.col("calories").alias("calories_snapshot"),
        F.col("protein_g").alias("protein_snapshot"),
        F.col("carbs_g").alias("carbs_snapshot"),
        F.col("fat_g").alias("fat_snapshot"))


def order_subtotal(requests: DataFrame, priced: DataFrame, key: str = "order_id") -> DataFrame:
    """Σ price × qty per request; NULL when none of its items matched a product."""
    sums = priced.groupBy(key).agg(F.sum("line_subtotal").alias("subtotal"))
    return requests.select(key).distinct().join(sums, key, "left")


def status_transitions(status_events: DataFrame, target: str, buckets: bool = True) -> DataFrame:
    """Events that move an order *into* ``target`` (previous status differs).

    The first event of an order is an insert, not an update, so it never
    counts (the reference fires on UPDATE only).
    """
    bucket = time_bucket("ts") if buckets else None
    e = previous_values(status_events, ["order_id"], ["ts", "event_id"], bucket, ["status"])
    return (e.filter((F.col("status") == target) & F.col("prev_status").isNotNull()
                     & (F.col("prev_status") != target))
            .select("order_id", "event_id", "ts"))


def preparing_exists(orders: DataFrame, transitions: DataFrame) -> DataFrame:
    """Orders with at least one event entering the status (left semi join)."""
    return orders.join(transitions.select("order_id"), "order_id", "left_semi").select("order_id", "status")


# Stage order used for durations (status reached -> next status).
STAGES = ["pending", "confirmed", "preparing", "ready", "done"]


def stage_steps(status_events: DataFrame) -> DataFrame:
    """(order_id, step, day, minutes): the time between the first times two stages that follow each other were
    reached, and the day the first of them was.

    One conditional aggregate per order (partial aggregation before the
    shuffle), then the stage pairs are unpivoted.
    """
    firsts = status_events.groupBy("order_id").agg(*[
        F.min(F.when(F.col("status") == s, F.col("ts"))).alias(f"t_{s}") for s in STAGES])
    pairs = list(zip(STAGES[:-1], STAGES[1:]))
    steps = F.array(*[
        F.struct(F.lit(f"{a}->{b}").alias("step"), F.to_date(f"t_{a}").alias("day"),
                 ((ntz_micros(f"t_{b}") - ntz_micros(f"t_{a}")) / F.lit(60_000_000.0)).alias("minutes"))
        for a, b in pairs])
    return (firsts.select("order_id", F.inline(steps))
            .filter(F.col("minutes").isNotNull()))


def status_durations(status_events: DataFrame) -> DataFrame:
    """Minutes between the first time each stage was reached, per order."""
    return stage_steps(status_events).select("order_id", "step", "minutes")


def duration_sketches(steps: DataFrame, *, k: int = 400) -> DataFrame:
    """(step, day, n, sketch): a quantile sketch (KLL) of the minutes per step and day.

    Sketches merge, so a table of them (some kilobytes a step and day, however
    many orders) answers any range of days. The rank error is below 1% for
    k = 400 (about 2.3 / k ** 0.9, in 99 of 100 sketches).
    """
    return steps.groupBy("step", "day").agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("minutes", F.lit(k)).alias("sketch"))


def duration_percentiles(sketches: DataFrame, *, date_from, date_to, probs=(0.5, 0.9, 0.99)) -> DataFrame:
    """(step, p, n, minutes) over the days from ``date_from`` to ``date_to``, by merging their sketches."""
    days = sketches.filter(F.col("day").between(lit_date(date_from), lit_date(date_to)))
    merged = days.groupBy("step").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    each = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(p)))
                              .alias("minutes")) for p in probs])
    return merged.select("step", "n", F.inline(each)).select("step", "p", "n", "minutes")


def rank_checked(percentiles: DataFrame, steps: DataFrame, *, date_from, date_to, error: float) -> DataFrame:
    """(step, p, n, within): whether each percentile's rank among the exact minutes is within ``error`` of p."""
    q = percentiles.select(F.col("step").alias("_step"), "p", F.col("minutes").alias("_q"))
    own = steps.filter(F.col("day").between(lit_date(date_from), lit_date(date_to)))
    # A handful of rows (steps x probabilities), each counted against its step's minutes.
    j = own.join(F.broadcast(q), F.col("step") == F.col("_step"))
    ranks = j.groupBy("step", "p").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("minutes") < F.col("_q")).alias("_lt"),
                                       F.count_if(F.col("minutes") <= F.col("_q")).alias("_le"))
    return ranks.select("step", "p", "n", ((F.col("_lt") / F.col("n") <= F.col("p") + error)
                                           & (F.col("_le") / F.col("n") >= F.col("p") - error)).alias("within"))


def status_history_check(status_events: DataFrame, buckets: bool = True) -> DataFrame:
    """Flag moves that go backward or skip a stage; cancel is allowed from anywhere."""
    bucket = time_bucket("ts") if buckets else None
    e = previous_values(status_events, ["order_id"], ["ts", "event_id"], bucket, ["status"])
    r_new, r_old = status_rank(F.col("status")), status_rank(F.col("prev_status"))
    problem = (F.when(F.col("prev_status") == "cancelled", "after_cancel")
               .when(F.col("status") == "cancelled", None)
               .when(r_new < r_old, "backward")
               .when(r_new > r_old + 1, "skipped"))
    return (e.filter(F.col("prev_status").isNotNull())
            .select("order_id", "event_id", F.col("prev_status").alias("from_status"),
                    F.col("status").alias("to_status"), problem.alias("problem"))
            .filter(F.col("problem").isNotNull()))


def order_notifications(orders: DataFrame) -> DataFrame:
    """One kitchen ``new_order`` notice per order, message with code and subtotal."""
    return orders.select(
        "order_id",
        F.lit("kitchen").alias("target_role"),
        F.lit("new_order").alias("type"),
        F.lit("Đơn hàng mới").alias("title"),
        F.concat(F.lit("Đơn "), F.col("order_code"), F.lit(" cần chế biến: "),
                 F.col("subtotal").cast("string")).alias("message"))


def order_progress(orders: DataFrame) -> DataFrame:
    """Status -> customer step 1..5 (0 for cancelled) and stages done."""
    from ..functions.rules import STATUS_STEP
    m = F.create_map(*[x for k, v in STATUS_STEP.items() for x in (F.lit(k), F.lit(v))])
    step = F.coalesce(m[F.col("status")], F.lit(0))
    return orders.select("order_id", "status", step.alias("step"),
                         F.greatest(step - 1, F.lit(0)).alias("stages_done"))


def kitchen_ticket_priority(status_events: DataFrame, *, as_of) -> DataFrame:
    """Orders whose latest status at ``as_of`` is pending: elapsed minutes and priority.

    Fixed values: >= 20 min high, >= 12 min medium, else normal; urgent from 15.
    """
    from ..functions.rules import lit_ts
    now = lit_ts(as_of)
    e = status_events.filter(F.col("ts") <= now)
    latest = e.groupBy("order_id").agg(F.max_by(F.struct("status", "ts"), F.struct("ts", "event_id")).alias("l"))
    pend = latest.filter(F.col("l.status") == "pending").select("order_id", F.col("l.ts").alias("arrived_at"))
    secs = (ntz_micros(now) - ntz_micros("arrived_at")) / F.lit(60_000_000)
    elapsed = F.coalesce(F.floor(secs), F.lit(0)).cast("bigint")
    return pend.select(
        "order_id", "arrived_at", elapsed.alias("elapsed_min"),
        F.when(elapsed >= 20, "high").when(elapsed >= 12, "medium").otherwise("normal").alias("priority"),
        (elapsed >= 15).alias("urgent"))


def kitchen_backlog(orders: DataFrame) -> DataFrame:
    """Counts of pending and preparing orders (both rows always present)."""
    c = orders.agg(F.count_if(F.col("status") == "pending").alias("pending"),
                   F.count_if(F.col("status") == "preparing").alias("preparing"))
    return c.select(F.inline(F.array(
        F.struct(F.lit("pending").alias("status"), F.col("pending").alias("n")),
        F.struct(F.lit("preparing").alias("status"), F.col("preparing").alias("n")))))


def label_rows(orders: DataFrame, order_items: DataFrame, products: DataFrame) -> DataFrame:
    """One label per order item: ``#<order>-<nn>`` (1-based, at least 2 digits), name, kcal, macros.

    The item number is a running count per order in (line_no, product,
    quantity, subtotal) order, computed two-level (1,000 lines a bucket), so
    even a huge order is numbered by many tasks. Numbers are padded to two
    digits and never cut.
    """
    from ..functions.windows import prefix_sums
    p = products.select(F.col("product_id").alias("_pid"), "name")
    items = order_items.join(p, order_items.product_id == p._pid, "left")
    numbered = prefix_sums(items, ["order_id"], ["line_no", "product_id", "quantity", "subtotal"],
                           F.floor(F.col("line_no") / 1000), {}, seq="_nn")
    nn = F.col("_nn").cast("string")
    return numbered.select(
        F.concat(F.lit("#"), F.col("order_id").cast("string"), F.lit("-"),
                 F.when(F.length(nn) < 2, F.lpad(nn, 2, "0")).otherwise(nn)).alias("label_id"),
        "order_id", "name", "quantity",
        F.col("calories_snapshot").alias("kcal"),
        dbl("protein_snapshot").alias("protein_g"), dbl("carbs_snapshot").alias("carbs_g"),
        dbl("fat_snapshot").alias("fat_g"))
