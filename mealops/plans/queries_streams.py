"""Catalogue entries: streams.

Keys backed by a streaming query run it to completion over the parquet
tables (``availableNow``) and return the final table; the oracle states the
batch meaning in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import streams as S
from .catalog import register
from .queries_core import FLOORED_CROSSINGS_SQL

STAGE_COLS = ", ".join(f"min(ts) FILTER (WHERE status = '{s}') AS {s}_at" for s in S.STAGES)


def _status_stream(b):
    return S.status_events_of(S.read_events_stream(b.spark, b.sf_dir))


def _ntz(df):
    """Streams carry session-zone timestamps; report them as the tables do (no zone)."""
    from pyspark.sql import types as T
    return df.select(*[F.col(f.name).cast("timestamp_ntz").alias(f.name)
                       if isinstance(f.dataType, T.TimestampType) else F.col(f.name) for f in df.schema.fields])


@register("order_stream", """
SELECT order_id AS id, 'online' AS type, status, ts AS arrived_at, event_id FROM status_events WHERE status = 'pending'""")
def q_order_stream(b):
    return _ntz(S.run_to_table(S.order_stream(_status_stream(b)), "order_stream"))


@register("order_status_stream", f"""
SELECT order_id, arg_max(status, (ts, event_id)) AS status, max(ts) AS updated_at, {STAGE_COLS}
FROM status_events GROUP BY order_id""")
def q_order_status_stream(b):
    return _ntz(S.run_to_table(S.order_status_stream(_status_stream(b)), "order_status_stream", keys=["order_id"]))


@register("shipper_position_stream", """
SELECT order_id, shipper_id, CAST(latitude AS DOUBLE) AS latitude, CAST(longitude AS DOUBLE) AS longitude, recorded_at
FROM (SELECT *, row_number() OVER (PARTITION BY order_id, shipper_id ORDER BY recorded_at DESC, event_id DESC) AS rn FROM pings) t
WHERE rn = 1""")
def q_shipper_position_stream(b):
    pings = S.pings_of(S.read_events_stream(b.spark, b.sf_dir))
    return _ntz(S.run_to_table(S.shipper_position_stream(pings), "shipper_position_stream",
                                keys=["order_id", "shipper_id"]))


@register("stock_deduction_stream", """
, tr AS (SELECT order_id, event_id, ts FROM (
    SELECT *, lag(status) OVER (PARTITION BY order_id ORDER BY ts, event_id) AS prev_status FROM status_events) t
    WHERE status = 'preparing' AND prev_status IS NOT NULL AND prev_status <> 'preparing'),
nd AS (SELECT pi.inventory_id, oi.order_id, sum(oi.quantity * pi.qty_per_portion) AS need
       FROM order_items oi JOIN product_ingredients pi ON pi.product_id = oi.product_id
       WHERE oi.order_id IN (SELECT order_id FROM tr) AND oi.order_id IN (SELECT order_id FROM orders_b)
         AND pi.inventory_id IN (SELECT inventory_id FROM inventory)
       GROUP BY 1, 2)
SELECT tr.event_id, tr.order_id, nd.inventory_id, 'export' AS action_type, CAST(-nd.need AS DOUBLE) AS quantity_change
FROM tr JOIN nd ON nd.order_id = tr.order_id""")
def q_stock_deduction_stream(b):
    import os
    import uuid

    from ..session import checkpoint_dir
    frames = {"orders": b.orders, "order_items": b.order_lines,
              "product_ingredients": b.product_ingredients, "inventory": b.inventory}
    base = os.path.join(checkpoint_dir(b.spark), "streams", f"stock_deduction-{uuid.uuid4().hex[:12]}")
    q = S.stock_deduction_stream(_status_stream(b), frames, os.path.join(base, "ledger"), os.path.join(base, "ck"))
    q.awaitTermination()
    schema = S.stock_deduction_twin(b.status_events, frames).schema
    # The per-batch folders (batch_id=<n>) are one table of ledger rows.
    return S.read_written(b.spark, os.path.join(base, "ledger"), schema)


@register("stock_after_deduction_stream", """
, tr AS (SELECT order_id FROM (
    SELECT *, lag(status) OVER (PARTITION BY order_id ORDER BY ts, event_id) AS prev_status FROM status_events) t
    WHERE status = 'preparing' AND prev_status IS NOT NULL AND prev_status <> 'preparing'),
used AS (SELECT pi.inventory_id, sum(oi.quantity * pi.qty_per_portion) AS used
         FROM tr JOIN orders_b o ON o.order_id = tr.order_id JOIN order_items oi ON oi.order_id = tr.order_id
         JOIN product_ingredients pi ON pi.product_id = oi.product_id GROUP BY 1)
SELECT i.inventory_id, CAST(CASE WHEN u.used IS NULL THEN i.quantity ELSE greatest(i.quantity - u.used, 0) END AS DOUBLE) AS quantity
FROM inventory i LEFT JOIN used u ON u.inventory_id = i.inventory_id""")
def q_stock_after_deduction_stream(b):
    """Stock after the streamed deductions: only exports are applied, so one floor at 0 equals one per step."""
    from ..operators import stock
    used = (q_stock_deduction_stream(b).groupBy("inventory_id")
            .agg(F.sum(-F.col("quantity_change")).alias("need")))
    return stock.stock_update_from(b.inventory, used)


@register("low_stock_alert_stream", """
, r AS (SELECT l.*, sum(quantity_change) OVER (PARTITION BY inventory_id ORDER BY created_at, order_id, line_no, action_type,
          quantity_change ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM inventory_logs l),
x AS (SELECT r.inventory_id, r.order_id, r.line_no, r.created_at, i.quantity + r.run - r.quantity_change AS before,
             i.quantity + r.run AS after, i.min_quantity
      FROM r JOIN inventory i ON i.inventory_id = r.inventory_id)
SELECT inventory_id, order_id, line_no, created_at, CAST(before AS DOUBLE) AS before, CAST(after AS DOUBLE) AS after
FROM x WHERE before > min_quantity AND after <= min_quantity""")
def q_low_stock_alert_stream(b):
    return _low_stock_alerts(b, S.low_stock_batch)


def _low_stock_alerts(b, fold):
    li = S.read_table_stream(b.spark, b.sf_dir, "lineitem")
    rf = F.col("l_returnflag")
    qty = F.col("l_quantity").cast("decimal(10,2)")
    ledger = li.select(
        F.col("l_partkey").alias("inventory_id"), F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        F.when(rf == "R", "waste").when(rf == "A", "import").otherwise("export").alias("action_type"),
        F.when(rf == "A", qty).otherwise(-qty).alias("quantity_change"), F.col("l_shipdate").alias("created_at"))
    import os
    import uuid

    from ..session import checkpoint_dir
    base = os.path.join(checkpoint_dir(b.spark), "streams", f"low_stock-{uuid.uuid4().hex[:12]}")
    out = os.path.join(base, "alerts")
    q = S.low_stock_alert_stream(ledger, b.inventory, out, os.path.join(base, "state"), os.path.join(base, "ck"),
                                 fold=fold)
    q.awaitTermination()
    cols = ["inventory_id", "order_id", "line_no", "created_at", "before", "after"]
    return b.spark.read.parquet(out).select(*cols)


@register("low_stock_alert_stream_floored", FLOORED_CROSSINGS_SQL)
def q_low_stock_alert_stream_floored(b):
    return _low_stock_alerts(b, S.low_stock_floored_batch)


@register("event_fanout", """
, e AS (SELECT event_id, user_id, CASE event_type WHEN 'signup' THEN 'new_order' WHEN 'view' THEN 'order_status_update'
          WHEN 'click' THEN 'shipper_location' WHEN 'purchase' THEN 'pickup_ready' ELSE 'inventory_updated' END AS event FROM events)
SELECT event_id, event, 'kitchen' AS room FROM e WHERE event = 'new_order'
UNION ALL SELECT event_id, event, 'customer' FROM e WHERE event = 'order_status_update'
UNION ALL SELECT event_id, event, 'order-' || CAST(user_id AS VARCHAR) FROM e WHERE event IN ('order_status_update', 'shipper_location')
UNION ALL SELECT event_id, event, 'shipper' FROM e WHERE event = 'pickup_ready'
UNION ALL SELECT event_id, event, 'admin' FROM e WHERE event = 'inventory_updated'""")
def q_event_fanout(b):
    return S.run_to_table(S.event_fanout(S.read_events_stream(b.spark, b.sf_dir)), "event_fanout")


@register("recent_events", """
, w AS (SELECT event_type, (epoch_us(ts) // 10000000) * 10000000 - k * 10000000 AS s
        FROM events, (SELECT unnest([0, 1, 2]) AS k) kk)
SELECT make_timestamp(s) AS window_start, make_timestamp(s + 30000000) AS window_end, event_type, count(*) AS n
FROM w GROUP BY 1, 2, 3""")
def q_recent_events(b):
    # The sliding-window counts as a stream in update mode: changed windows are upserted.
    ev = S.read_events_stream(b.spark, b.sf_dir)
    return S.run_to_table(S.recent_events(ev), "recent_events",
                          keys=["window_start", "window_end", "event_type"])


RATE_W, RATE_MAX = 86_400_000, 2


@register("rate_limit_violations", f"""
, r AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id, ts, epoch_us(ts) AS us,
          row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS rn FROM events),
f AS (SELECT key, event_id, ts, rn, us, 1 AS cnt, us + {RATE_W * 1000} AS reset FROM r WHERE rn = 1
      UNION ALL
      SELECT r.key, r.event_id, r.ts, r.rn, r.us, CASE WHEN r.us > f.reset THEN 1 ELSE f.cnt + 1 END,
             CASE WHEN r.us > f.reset THEN r.us + {RATE_W * 1000} ELSE f.reset END
      FROM f JOIN r ON r.key = f.key AND r.rn = f.rn + 1)
SELECT key, event_id, ts, CAST(cnt AS BIGINT) AS count, CAST(greatest(0, {RATE_MAX} - cnt) AS BIGINT) AS remaining,
       cnt > {RATE_MAX} AS blocked FROM f""", recursive=True)
def q_rate_limit_violations(b):
    return S.rate_limit_violations(b.raw("events"), key_col="user_id", window_ms=RATE_W, limit=RATE_MAX)


@register("rate_limit_stream", f"""
, r AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id, ts, epoch_us(ts) AS us,
          row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS rn FROM events),
f AS (SELECT key, event_id, ts, rn, us, 1 AS cnt, us + {RATE_W * 1000} AS reset FROM r WHERE rn = 1
      UNION ALL
      SELECT r.key, r.event_id, r.ts, r.rn, r.us, CASE WHEN r.us > f.reset THEN 1 ELSE f.cnt + 1 END,
             CASE WHEN r.us > f.reset THEN r.us + {RATE_W * 1000} ELSE f.reset END
      FROM f JOIN r ON r.key = f.key AND r.rn = f.rn + 1)
SELECT key, event_id, ts, CAST(cnt AS BIGINT) AS count, CAST(greatest(0, {RATE_MAX} - cnt) AS BIGINT) AS remaining,
       cnt > {RATE_MAX} AS blocked FROM f""", recursive=True)
def q_rate_limit_stream(b):
    ev = S.read_table_stream(b.spark, b.sf_dir, "events")
    return S.run_to_table(S.rate_limit_stream(ev, key_col="user_id", window_ms=RATE_W, limit=RATE_MAX), "rate_limit_stream")


ONCE_TTL_MS = 7 * 86_400_000


@register("stock_deduction_once_stream", f"""
, p AS (SELECT *, lag(status) OVER w AS prev_status, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w > {ONCE_TTL_MS * 1000}, false) AS paused
        FROM status_events WINDOW w AS (PARTITION BY order_id ORDER BY ts, event_id)),
s AS (SELECT *, count(*) FILTER (paused) OVER (PARTITION BY order_id ORDER BY ts, event_id) AS spell FROM p),
tr AS (SELECT order_id, spell, arg_min(event_id, (ts, event_id)) AS event_id FROM s
       WHERE status = 'preparing' AND prev_status IS NOT NULL AND prev_status <> 'preparing' AND NOT paused GROUP BY 1, 2),
nd AS (SELECT pi.inventory_id, oi.order_id, sum(oi.quantity * pi.qty_per_portion) AS need
       FROM order_items oi JOIN product_ingredients pi ON pi.product_id = oi.product_id
       WHERE oi.order_id IN (SELECT order_id FROM tr) AND oi.order_id IN (SELECT order_id FROM orders_b)
         AND pi.inventory_id IN (SELECT inventory_id FROM inventory)
       GROUP BY 1, 2)
SELECT tr.event_id, tr.order_id, nd.inventory_id, 'export' AS action_type, CAST(-nd.need AS DOUBLE) AS quantity_change
FROM tr JOIN nd ON nd.order_id = tr.order_id""")
def q_stock_deduction_once_stream(b):
    """Every third event is delivered twice; an order is deducted once in a spell of events."""
    import os
    import uuid

    from ..session import checkpoint_dir
    frames = {"orders": b.orders, "order_items": b.order_lines,
              "product_ingredients": b.product_ingredients, "inventory": b.inventory}
    base = os.path.join(checkpoint_dir(b.spark), "streams", f"deduct_once-{uuid.uuid4().hex[:12]}")
    again = _status_stream(b).filter(F.col("event_id") % 3 == 0)
    q = S.stock_deduction_once_stream(_status_stream(b).unionByName(again), frames, os.path.join(base, "ledger"),
                                      os.path.join(base, "ck"), ttl_ms=ONCE_TTL_MS)
    q.awaitTermination()
    schema = S.stock_deduction_twin(b.status_events, frames).schema
    return S.read_written(b.spark, os.path.join(base, "ledger"), schema)


@register("late_event_counts", """
, wm AS (SELECT epoch_ms(max(ts)) - 86400000 AS ms FROM events WHERE event_id % 10 <> 0)
SELECT count(*) FILTER (NOT late) AS n_on_time, count(*) FILTER (late) AS n_late
FROM (SELECT event_id % 10 = 0 AND epoch_us(ts) <= ms * 1000 AS late FROM events, wm)""")
def q_late_event_counts(b):
    """A tenth of the events arrives after the others: those later than a day are dropped, and counted."""
    import os
    import uuid

    from ..session import checkpoint_dir
    base = os.path.join(checkpoint_dir(b.spark), "streams", f"late-{uuid.uuid4().hex[:12]}")
    feed, out = os.path.join(base, "feed"), os.path.join(base, "out")
    events = b.raw("events")
    late = 0
    for arriving in (events.filter(F.col("event_id") % 10 != 0), events.filter(F.col("event_id") % 10 == 0)):
        arriving.write.mode("append").parquet(feed)
        stream = b.spark.readStream.schema(events.schema).parquet(feed).withColumn("ts", F.col("ts").cast("timestamp"))
        q = (S.on_time(stream, "1 day").writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", os.path.join(base, "ck")).trigger(availableNow=True).start())
        late += S.reported(q).late_rows
    kept = S.read_written(b.spark, out, events.withColumn("ts", F.col("ts").cast("timestamp")).schema)
    return kept.agg(F.count(F.lit(1)).alias("n_on_time")).select("n_on_time", F.lit(late).cast("long").alias("n_late"))


@register("daily_revenue_kept", """
SELECT CAST(created_at AS DATE) AS report_date, count(*) AS total_orders, CAST(sum(total) AS DOUBLE) AS total_revenue,
       CAST(sum(discount_amount) AS DOUBLE) AS total_discount
FROM orders_b WHERE status <> 'cancelled' AND order_id % 7 <> 0 GROUP BY 1""")
def q_daily_revenue_kept(b):
    """Orders come in versions, in mixed order: placed without a discount, then as they are, then some cancelled."""
    import os
    import uuid

    from ..session import checkpoint_dir
    base = os.path.join(checkpoint_dir(b.spark), "streams", f"kept-{uuid.uuid4().hex[:12]}")
    o, version = b.orders, F.col("version")
    kept = o.select("order_id", F.explode(F.when(F.col("order_id") % 7 == 0, F.array(F.lit(0), F.lit(1), F.lit(2)).cast("array<bigint>"))
                                          .otherwise(F.array(F.lit(0), F.lit(1)).cast("array<bigint>"))).alias("version"),
                    F.to_date("created_at").alias("day"), "status", "subtotal", "total", "discount_amount")
    kept = kept.select(
        "order_id", "version", "day",
        F.when(version == 0, "pending").when(version == 2, "cancelled").otherwise(F.col("status")).alias("status"),
        F.when(version == 0, F.col("subtotal")).otherwise(F.col("total")).cast("decimal(18,2)").alias("total"),
        F.when(version == 0, F.lit(0)).otherwise(F.col("discount_amount")).cast("decimal(18,2)").alias("discount"))
    feed, state = os.path.join(base, "feed"), os.path.join(base, "state")
    for turn in range(3):                            # an order's versions come in any of the orders of three
        kept.where((F.col("order_id") * 2 + version) % 3 == turn).write.mode("append").parquet(feed)
        stream = b.spark.readStream.schema(S.KEPT_ORDER).parquet(feed)
        S.kept_revenue_stream(stream, state, os.path.join(base, "ck"), compact_every=2).awaitTermination()
    return S.kept_revenue(b.spark, state, compact_every=2)
