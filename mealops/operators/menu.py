"""Menu listings, filters, calendar and capacity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import lit_date, with_scalars
from ..functions.windows import global_position, prefix_sums
from ..sources.parse import tags_array

# The goal chips offered on the menu pages.
CHIPS = ["all", "eat-clean", "keto", "low-carb", "high-protein", "giamcan"]

# Menu sort options -> (column, ascending).
SORTS = {"price_asc": ("price", True), "price_desc": ("price", False),
         "cal_asc": ("calories", True), "cal_desc": ("calories", False)}


def products_listing(products: DataFrame, categories: DataFrame, *, available: bool | None = True,
                     category_slug: str | None = None, limit: int = 100) -> DataFrame:
    """Products with their category, by product_id, first ``limit`` rows."""
    c = categories.select(F.col("name").alias("_cname"), "slug")
    p = products.join(c, products.category == c._cname, "left")
    if available is not None:
        p = p.filter(F.col("is_available") == F.lit(available))
    if category_slug:
        p = p.filter(F.col("slug") == category_slug)
    return (p.select("product_id", "name", "price", "calories", F.col("_cname").alias("category"))
            .orderBy("product_id").limit(limit))


def tag_match(tag: str | Column) -> Column:
    """category = tag OR some lower-cased tag contains it; ``all``/empty matches everything."""
    t = F.lit(tag) if isinstance(tag, str) else tag
    return ((t == F.lit("all")) | (t == F.lit("")) | (F.col("category") == t)
            | F.exists(tags_array(), lambda x: F.contains(F.lower(x), t)))


def menu_filter(products: DataFrame, *, tag: str = "all", q: str = "") -> DataFrame:
    p = products.filter(tag_match(tag))
    q = (q or "").strip().lower()
    if q:
        p = p.filter(F.contains(F.lower("name"), F.lit(q))
                     | F.contains(F.lower(F.coalesce("description", F.lit(""))), F.lit(q)))
    return p.select("product_id", "name")


def menu_chip_matches(products: DataFrame, chips=CHIPS) -> DataFrame:
    """Matching products per chip: one conditional count per chip in a single pass."""
    counts = products.agg(*[F.count_if(tag_match(c)).alias(f"c{i}") for i, c in enumerate(chips)])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("chip"), F.col(f"c{i}").alias("n")) for i, c in enumerate(chips)])))


def menu_sort(products: DataFrame, option: str = "price_asc") -> DataFrame:
    """Products in the chosen order with a dense global position ``pos``."""
    col, asc = SORTS.get(option, SORTS["price_asc"])
    key = F.col(col).asc() if asc else F.col(col).desc()
    p = products.select("product_id", "price", "calories")
    return global_position(p, [key, F.col("product_id").asc()], "pos")


def _week(df: DataFrame, week_start) -> DataFrame:
    lo = lit_date(week_start)
    return df.filter((F.col("schedule_date") >= lo) & (F.col("schedule_date") < F.date_add(lo, 7)))


DAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]


def menu_calendar(menu_schedule: DataFrame, products: DataFrame, *, week_start) -> DataFrame:
    """Monday-first week grid: one row per (meal, slot), one column per day.

    Each cell holds one dish; a (day, meal) with n dishes fills slots 1..n.
    The grid is built with ``pivot`` over fixed day values, so no list is
    collected per cell.
    """
    s = _week(menu_schedule, week_start)
    p = products.select(F.col("product_id").alias("_pid"), "name")
    j = s.join(p, s.product_id == p._pid).select(
        "schedule_date", "meal_type", "product_id", "name",
        (F.weekday("schedule_date") + 1).alias("dow"))
    # Slot = position of the dish in its (day, meal) cell by (name, id); two-level
    # with the name's first character as bucket (a prefix of that order).
    j = prefix_sums(j, ["schedule_date", "meal_type"], ["name", "product_id"],
                    F.substring("name", 1, 1), {}, seq="slot")
    j = j.withColumn("slot", F.col("slot").cast("int"))
    g = j.groupBy("meal_type", "slot").pivot("dow", list(range(1, 8))).agg(F.first("name"))
    return g.select("meal_type", "slot", *[F.col(str(i + 1)).alias(d) for i, d in enumerate(DAYS)])


def menu_capacity(menu_schedule: DataFrame, order_items: DataFrame, orders: DataFrame) -> DataFrame:
    """Portions sold vs max_quantity per scheduled (date, product)."""
    o = orders.filter(F.col("status") != "cancelled").select("order_id", F.to_date("created_at").alias("schedule_date"))
    sched_keys = menu_schedule.select("schedule_date", "product_id").distinct()
    items = (order_items.select("order_id", "product_id", "quantity").join(o, "order_id")
             .join(sched_keys, ["schedule_date", "product_id"], "left_semi"))
    sold = items.groupBy("schedule_date", "product_id").agg(F.sum("quantity").cast("bigint").alias("sold"))
    j = menu_schedule.join(sold, ["schedule_date", "product_id"], "left")
    sold_c = F.coalesce("sold", F.lit(0).cast("bigint"))
    return j.select("schedule_date", "product_id", "meal_type", "max_quantity", sold_c.alias("sold"),
                    F.greatest(F.col("max_quantity") - sold_c, F.lit(0).cast("bigint")).alias("remaining"),
                    (sold_c >= F.col("max_quantity")).alias("sold_out"))


# Fixed values (our rule): meals covered per day by a plan's meals_per_day.
PLAN_MEALS = {1: ["lunch"], 2: ["lunch", "dinner"], 3: ["breakfast", "lunch", "dinner"]}


def subscriber_cover(active_subs: DataFrame, plans: DataFrame) -> DataFrame:
    """Active subscribers per (dow, meal): a plan covers its meals on days 1..days_per_week."""
    per_plan = active_subs.groupBy("plan_id").agg(F.count(F.lit(1)).alias("subs"))
    meals = F.create_map(*[x for k, v in PLAN_MEALS.items()
                           for x in (F.lit(k), F.array(*[F.lit(m) for m in v]))])
    j = per_plan.join(F.broadcast(plans.select("plan_id", "meals_per_day", "days_per_week")), "plan_id")
    e = j.select("subs", F.explode(meals[F.col("meals_per_day")]).alias("meal_type"),
                 F.explode(F.sequence(F.lit(1), F.col("days_per_week"))).alias("dow"))
    return e.groupBy("dow", "meal_type").agg(F.sum("subs").alias("subscribers"))


def ingredient_need_from_schedule(menu_schedule: DataFrame, active_subs: DataFrame, plans: DataFrame,
                                  product_ingredients: DataFrame, *, week_start) -> DataFrame:
    """Weekly need per ingredient: (scheduled portions + covering subscribers) through the BOM."""
    s = _week(menu_schedule, week_start).withColumn("dow", F.weekday("schedule_date") + 1)
    cover = subscriber_cover(active_subs, plans)
    s = s.join(F.broadcast(cover), ["dow", "meal_type"], "left")
    portions = (F.col("max_quantity") + F.coalesce("subscribers", F.lit(0))).alias("portions")
    per_product = s.groupBy("product_id").agg(F.sum(portions).alias("portions"))
    j = per_product.join(product_ingredients, "product_id")
    return j.groupBy("inventory_id").agg(F.sum(F.col("portions") * F.col("qty_per_portion")).alias("need"))


def menu_week_stats(menu_schedule: DataFrame, products: DataFrame, active_subs: DataFrame,
                    plan: DataFrame, *, week_start) -> DataFrame:
    """One row: servings scheduled, active subscriptions, quantity to buy, expected revenue.

    ``plan`` is the ingredient plan (#76) of the week's need; its total row
    is the one without an ingredient id.
    """
    s = _week(menu_schedule, week_start)
    p = products.select(F.col("product_id"), "price")
    serv = s.join(p, "product_id").agg(
        F.sum("max_quantity").cast("bigint").alias("servings"),
        F.sum(F.col("max_quantity") * F.col("price")).alias("revenue"))
    subs = active_subs.agg(F.count(F.lit(1)).alias("active_subs"))
    buy = plan.filter(F.col("inventory_id").isNotNull()).agg(F.sum("shortfall").alias("buy_qty"))
    return with_scalars(serv, subs, buy).select("servings", "active_subs", "buy_qty", "revenue")
