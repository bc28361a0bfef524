"""Inventory status, bill of materials, ledger balances and stock planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import days_until, dbl, expiry_status, lit_date, ratio, stock_status, with_scalars
from ..functions.spread import spread
from ..functions.windows import RANGES, last_non_null, prefix_sums, prefix_sums_and_lows


def inventory_by_category(inventory: DataFrame, category: str | Column | None = None) -> DataFrame:
    """Items of one category (a name, or a scalar subquery); None or ``all`` keeps every item."""
    every = category is None or (isinstance(category, str) and category in ("", "all"))
    inv = inventory if every else inventory.filter(F.col("category") == category)
    return inv.select("inventory_id", "name")


def inventory_status(inventory: DataFrame, suppliers: DataFrame, *, as_of) -> DataFrame:
    """Stock rows with supplier name, days to expiry and the two status bands.

    Negative days (already expired) count as critical.
    """
    s = suppliers.select(F.col("supplier_id").alias("_sid"), F.col("name").alias("supplier_name"))
    days = days_until("expiry_date", as_of)
    return (inventory.join(s, inventory.supplier_id == s._sid, "left").drop("_sid")
            .withColumn("days_until_expiry", days)
            .withColumn("expiry_status", expiry_status(F.col("days_until_expiry")))
            .withColumn("stock_status", stock_status(F.col("quantity"), F.col("min_quantity"))))


def inventory_listing(status: DataFrame) -> DataFrame:
    """Status rows with dd/MM dates, soonest expiry first, then smallest quantity."""
    return (status.select("inventory_id", "name", "supplier_name", "quantity",
                          F.date_format("import_date", "dd/MM").alias("import_day"),
                          F.date_format("expiry_date", "dd/MM").alias("expiry_day"),
                          "days_until_expiry", "expiry_status", "stock_status")
            .orderBy("days_until_expiry", "quantity", "inventory_id"))


def inventory_status_counts(status: DataFrame) -> DataFrame:
    return status.groupBy(F.col("expiry_status").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def restock_suggestions(status: DataFrame) -> DataFrame:
    return (status.filter(F.col("expiry_status") != "ok")
            .select("inventory_id", "name", "quantity", "expiry_status", "days_until_expiry"))


def expiry_notifications(status: DataFrame) -> DataFrame:
    """One admin notice per warning or critical item."""
    return (status.filter(F.col("expiry_status").isin("warning", "critical"))
            .select("inventory_id", F.lit("admin").alias("target_role"),
                    F.lit("expiry_warning").alias("type"),
                    F.concat(F.col("name"), F.lit(" hết hạn sau "), F.col("days_until_expiry").cast("string"),
                             F.lit(" ngày (" ), F.col("expiry_status"), F.lit(")")).alias("message")))


def stock_bar(inventory: DataFrame) -> DataFrame:
    """Quantity > 8 high, > 3 medium, else low; width = min(100, qty * 8)."""
    q = F.col("quantity")
    return inventory.select(
        "inventory_id", "name", "quantity",
        F.when(q > 8, "high").when(q > 3, "medium").otherwise("low").alias("level"),
        F.least(F.lit(100).cast("decimal(10,2)"), q * 8).alias("width"))


def bom_explosion(orders: DataFrame, order_items: DataFrame, product_ingredients: DataFrame,
                  inventory: DataFrame, *, status: str = "preparing") -> DataFrame:
    """Ingredient need per (inventory_id, order_id) of orders in ``status``.

    need = Σ quantity × qty_per_portion. Item rows are reduced to the
    orders in scope with a semi join, and the recipe to known ingredients,
    before the fan-out. The rows are sorted and summed by tasks whose number
    follows the item rows: (item, order) pairs are nearly as many.
    """
    lines = order_items.select("order_id", "product_id", "quantity")
    o = spread(orders.filter(F.col("status") == status).select("order_id"), ["order_id"], [lines], 2 << 20)
    items = lines.join(o, "order_id", "left_semi")
    inv = inventory.select("inventory_id")
    bom = product_ingredients.select("product_id", "inventory_id", "qty_per_portion").join(inv, "inventory_id", "left_semi")
    j = items.join(spread(bom, ["product_id"], [lines], 2 << 20), "product_id").select(
        "inventory_id", "order_id", (F.col("quantity") * F.col("qty_per_portion")).alias("need"))
    return spread(j, ["inventory_id", "order_id"], [lines], 1 << 20).groupBy("inventory_id", "order_id").agg(
        F.sum("need").alias("need"))


def need_by_item(bom_need: DataFrame) -> DataFrame:
    return bom_need.groupBy("inventory_id").agg(F.sum("need").alias("need"))


def stock_update_from(inventory: DataFrame, need: DataFrame) -> DataFrame:
    """New quantity = max(quantity - used, 0) for used items; others unchanged."""
    used = need.select("inventory_id", F.col("need").alias("used"))
    j = inventory.select("inventory_id", "quantity").join(used, "inventory_id", "left")
    q = F.when(F.col("used").isNull(), F.col("quantity").cast("decimal(18,3)")).otherwise(
        F.greatest(F.col("quantity") - F.col("used"), F.lit(0).cast("decimal(18,3)")))
    return j.select("inventory_id", q.alias("quantity"))


_LEDGER_ORDER = ["created_at", "order_id", "line_no", "action_type", "quantity_change"]


def stock_running_balance(logs: DataFrame) -> DataFrame:
    """Running Σ quantity_change per item in ledger order (position ``seq``).

    A scan over ranges of (item, ledger order), so a hot item spreads over
    many tasks, also if all its rows carry one instant.
    """
    r = prefix_sums(logs, ["inventory_id"], _LEDGER_ORDER, RANGES,
                    {"balance": F.col("quantity_change")}, seq="seq")
    return r.select("inventory_id", "order_id", "line_no", "seq", "balance")


def low_stock_crossings(logs: DataFrame, inventory: DataFrame) -> DataFrame:
    """Ledger rows where stock moves from above min_quantity to at or below it.

    Opening stock is the inventory quantity; each row's ``after`` is opening +
    running Σ change and ``before`` = after − change. Stock may fall below 0
    here; ``low_stock_crossings_floored`` is what the reference does.
    """
    r = prefix_sums(logs, ["inventory_id"], _LEDGER_ORDER, RANGES,
                    {"run": F.col("quantity_change")})
    inv = inventory.select("inventory_id", "quantity", "min_quantity")
    j = r.join(inv, "inventory_id")
    after = F.col("quantity") + F.col("run")
    before = after - F.col("quantity_change")
    return (j.select("inventory_id", "order_id", "line_no", "created_at",
                     before.alias("before"), after.alias("after"), "min_quantity")
            .filter((F.col("before") > F.col("min_quantity")) & (F.col("after") <= F.col("min_quantity")))
            .drop("min_quantity"))


def floored(opening: Column, run: Column, low: Column) -> Column:
    """Stock after a running change ``run`` when every step is floored at 0.

    ``low`` is the least running change so far (NULL before the first row);
    what the floor kept back until now is the part of opening + low under 0.
    """
    return opening + run - F.least(F.lit(0), opening + low)


def low_stock_crossings_floored(logs: DataFrame, inventory: DataFrame) -> DataFrame:
    """``low_stock_crossings`` with stock floored at 0 after every ledger row.

    The reference deducts down to 0 at most, so an import after a long run of
    exports lifts the item from 0 and a later fall is a crossing of its own.
    """
    r = prefix_sums_and_lows(logs, ["inventory_id"], _LEDGER_ORDER, RANGES,
                             F.col("quantity_change"), "run", "low")
    inv = inventory.select("inventory_id", "quantity", "min_quantity")
    j = r.join(inv, "inventory_id")
    before = floored(F.col("quantity"), F.col("run") - F.col("quantity_change"), F.col("low"))
    after = floored(F.col("quantity"), F.col("run"), F.least("low", "run"))
    return (j.select("inventory_id", "order_id", "line_no", "created_at",
                     before.alias("before"), after.alias("after"), "min_quantity")
            .filter((F.col("before") > F.col("min_quantity")) & (F.col("after") <= F.col("min_quantity")))
            .drop("min_quantity"))


def low_stock_notifications(crossings: DataFrame, inventory: DataFrame) -> DataFrame:
    """One admin notice per ledger row that takes an item to or below its minimum."""
    # Role, type, title and the words of the message.
    inv = inventory.select("inventory_id", "name")
    left = F.col("after").cast("decimal(18,2)").cast("string")
    return crossings.join(inv, "inventory_id").select(
        "inventory_id", "order_id", "line_no", "created_at", F.lit("admin").alias("target_role"),
        F.lit("inventory_alert").alias("type"), F.lit("Cảnh báo kho nguyên liệu").alias("title"),
        F.concat(F.lit('Nguyên liệu "'), F.col("name"), F.lit('" còn '), left, F.lit(" (dưới mức tối thiểu)")).alias("message"))


def fifo_allocation(batches: DataFrame, needs: DataFrame, *, width: int | None = None) -> DataFrame:
    """First-in-first-out allocation of needs to stock batches, per item.

    ``batches``/``needs``: (inventory_id, <id cols>, ts, qty), qty > 0, ids
    ``batch_order, batch_line`` / ``need_order, need_line``. Supply and
    demand become cumulative ranges; each allocation starts at a range
    boundary, so a forward fill over the merged boundaries yields every
    (batch, need) overlap in O(rows) without pairing rows. Both scans run over
    ranges of their order, so a hot item is many tasks; with ``width`` the
    second one runs over spans of so many quantity units.
    """
    # Supply and demand ranges in one pass: tag each side, key by (item, side).
    both = (batches.select("inventory_id", F.lit(0).alias("side"), F.col("batch_order").alias("o"),
                           F.col("batch_line").alias("l"), "ts", "qty")
            .unionByName(needs.select("inventory_id", F.lit(1).alias("side"), F.col("need_order").alias("o"),
                                      F.col("need_line").alias("l"), "ts", "qty")))
    return _allocated(both, width)


def fifo_ledger(logs: DataFrame, *, width: int | None = None) -> DataFrame:
    """``fifo_allocation`` of a ledger's imports to its exports, tagged in one scan."""
    action, change = F.col("action_type"), F.col("quantity_change")
    both = logs.filter(action.isin("import", "export")).select(
        "inventory_id", F.when(action == "import", 0).otherwise(1).alias("side"), F.col("order_id").alias("o"),
        F.col("line_no").alias("l"), F.col("created_at").alias("ts"),
        F.when(action == "import", change).otherwise(-change).alias("qty"))
    return _allocated(both, width)


def _allocated(both: DataFrame, width: int | None) -> DataFrame:
    """``both``: supply (side 0) and demand (side 1) rows."""
    r = prefix_sums(both, ["inventory_id", "side"], ["ts", "o", "l", "qty"], RANGES,
                    {"hi": F.col("qty")})
    rng = F.struct(F.col("o"), F.col("l"), F.col("hi"))
    r = r.select("inventory_id", (F.col("hi") - F.col("qty")).alias("pos"),
                 F.when(F.col("side") == 0, rng).alias("b"), F.when(F.col("side") == 1, rng).alias("n"))
    bounds = r.groupBy("inventory_id", "pos").agg(F.max("b").alias("b"), F.max("n").alias("n"))
    bucket = RANGES if width is None else F.floor(F.col("pos") / F.lit(width))
    ff = last_non_null(bounds, ["inventory_id"], ["pos"], bucket, {"b": "fb", "n": "fn"})
    qty = F.least(F.col("fb.hi"), F.col("fn.hi")) - F.col("pos")
    return (ff.filter(F.col("fb").isNotNull() & F.col("fn").isNotNull())
            .select("inventory_id", F.col("fn.o").alias("need_order"),
                    F.col("fn.l").alias("need_line"),
                    F.col("fb.o").alias("batch_order"),
                    F.col("fb.l").alias("batch_line"), qty.alias("qty"))
            .filter(F.col("qty") > 0))


def ledger_batches(logs: DataFrame) -> DataFrame:
    return logs.filter(F.col("action_type") == "import").select(
        "inventory_id", F.col("order_id").alias("batch_order"), F.col("line_no").alias("batch_line"),
        F.col("created_at").alias("ts"), F.col("quantity_change").alias("qty"))


def ledger_needs(logs: DataFrame) -> DataFrame:
    return logs.filter(F.col("action_type") == "export").select(
        "inventory_id", F.col("order_id").alias("need_order"), F.col("line_no").alias("need_line"),
        F.col("created_at").alias("ts"), (-F.col("quantity_change")).alias("qty"))


def food_waste_pct(logs: DataFrame, *, date_from, date_to) -> DataFrame:
    """waste = Σ|waste|, used = Σ|export + waste|, pct = waste / used × 100 (NULL when nothing was used)."""
    lo = lit_date(date_from).cast("timestamp_ntz")
    hi = F.date_add(lit_date(date_to), 1).cast("timestamp_ntz")
    l = logs.filter((F.col("created_at") >= lo) & (F.col("created_at") < hi))
    a = F.abs(F.col("quantity_change"))
    agg = l.agg(F.sum(F.when(F.col("action_type") == "waste", a)).alias("waste"),
                F.sum(F.when(F.col("action_type").isin("export", "waste"), a)).alias("used"))
    return agg.select(dbl("waste").alias("waste"), dbl("used").alias("used"),
                      ratio(dbl("waste") * 100.0, "used").alias("waste_pct"))


def receipts_today(logs: DataFrame, *, day) -> DataFrame:
    """Import rows of one day, newest first, each with the day's count."""
    lo = lit_date(day).cast("timestamp_ntz")
    hi = F.date_add(lit_date(day), 1).cast("timestamp_ntz")
    r = logs.filter((F.col("action_type") == "import") & (F.col("created_at") >= lo) & (F.col("created_at") < hi))
    n = r.agg(F.count(F.lit(1)).alias("n_today"))
    return (with_scalars(r.select("inventory_id", "order_id", "line_no",
                                  F.col("quantity_change").alias("quantity"), "created_at"), n)
            .orderBy(F.col("created_at").desc(), F.col("order_id").desc(), F.col("line_no").desc()))


def ingredient_plan(need: DataFrame, inventory: DataFrame) -> DataFrame:
    """Need vs stock per ingredient plus a grand-total row (``rollup``).

    shortfall = max(0, need − stock); cost = shortfall × unit price; band:
    stock < 30% of need red, < 70% mid, else ok (fixed values).
    """
    inv = inventory.select("inventory_id", "name", F.col("quantity").alias("stock"), "unit_price")
    j = need.join(inv, "inventory_id")
    shortfall = F.greatest(F.col("need") - F.col("stock"), F.lit(0))
    rows = j.select("inventory_id", "name", "need", "stock", shortfall.alias("shortfall"),
                    (shortfall * F.col("unit_price")).alias("cost"),
                    F.when(F.col("stock") < F.col("need") * F.lit(0.3).cast("decimal(2,1)"), "red")
                     .when(F.col("stock") < F.col("need") * F.lit(0.7).cast("decimal(2,1)"), "mid")
                     .otherwise("ok").alias("band"))
    total = F.grouping("inventory_id") == 1
    return (rows.rollup("inventory_id")
            .agg(F.max("name").alias("name"), F.sum("need").alias("need"), F.sum("stock").alias("stock"),
                 F.sum("shortfall").alias("shortfall"), F.sum("cost").alias("cost"),
                 F.max("band").alias("band"), F.grouping("inventory_id").alias("g"))
            .select("inventory_id",
                    F.when(F.col("g") == 1, F.lit("TOTAL")).otherwise(F.col("name")).alias("name"),
                    "need", "stock", "shortfall", "cost",
                    F.when(F.col("g") == 1, F.lit(None)).otherwise(F.col("band")).alias("band")))


def forecast_ingredients(current: DataFrame) -> DataFrame:
    """next = round(current × (1 + growth/100)) (JS rounding: floor(x + 0.5)); urgent when growth ≥ 25.

    ``current``: (key..., current, growth) with integral current and growth.
    """
    nxt = F.floor((F.col("current") * (F.lit(100) + F.col("growth")) + F.lit(50)) / F.lit(100))
    return current.select("*", nxt.cast("bigint").alias("next_week"),
                          (F.col("growth") >= 25).alias("urgent"))


def weekly_usage_growth(logs: DataFrame, *, as_of) -> DataFrame:
    """Per item: exported quantity in the 7 days before ``as_of`` and growth % vs the 7 before that."""
    now = lit_date(as_of)
    d = F.to_date("created_at")
    e = logs.filter((F.col("action_type") == "export") & (d >= F.date_sub(now, 14)) & (d < now))
    q = -F.col("quantity_change")
    g = e.groupBy("inventory_id").agg(
        F.sum(F.when(d >= F.date_sub(now, 7), q).otherwise(0)).cast("bigint").alias("current"),
        F.sum(F.when(d < F.date_sub(now, 7), q).otherwise(0)).cast("bigint").alias("previous"))
    growth = F.when(F.col("previous") == 0, F.lit(0)).otherwise(
        F.floor((F.col("current") - F.col("previous")) * 100.0 / F.col("previous") + 0.5))
    return g.select("inventory_id", "current", growth.cast("bigint").alias("growth"))
