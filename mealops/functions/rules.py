"""Shared column expressions.

Everything here returns a ``Column`` made of Spark built-ins, so it stays
inside whole-stage codegen. Thresholds that must equal the reference's are
grouped under "fixed values" comments.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["with_scalars", "ntz_micros", 
    "col_or", "as_date", "money", "dbl", "ratio", "days_until",
    "expiry_status", "stock_status", "ORDER_STATUSES", "STATUS_STEP",
    "status_rank", "not_cancelled", "lit_date", "lit_ts",
]

# Order statuses in their forward order (the orders CHECK list).
ORDER_STATUSES = ["pending", "confirmed", "preparing", "ready", "delivering", "done", "cancelled"]

# Customer progress steps (placed, confirmed, cooking,
# delivering, received) by status.
STATUS_STEP = {"pending": 1, "confirmed": 2, "preparing": 3, "ready": 3,
               "delivering": 4, "done": 5}


def col_or(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit_date(d) -> Column:
    return F.lit(str(d)).cast("date")


def lit_ts(t) -> Column:
    return F.lit(str(t)).cast("timestamp_ntz")


def ntz_micros(c) -> Column:
    """Microseconds since 1970-01-01 00:00 of a wall-clock (``timestamp_ntz``) value.

    Uses ``timestamp_diff`` on the wall-clock values, so differences do not
    depend on the session time zone or its daylight-saving shifts (a cast to
    ``timestamp`` followed by ``unix_micros`` would).
    """
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            col_or(c).cast("timestamp_ntz"))


def as_date(c) -> Column:
    return col_or(c).cast("date")


def money(c, scale: int = 2) -> Column:
    """Exact decimal for sums (widened to 18 digits)."""
    return col_or(c).cast(f"decimal(18,{scale})")


def dbl(c) -> Column:
    return col_or(c).cast("double")


def ratio(num, den) -> Column:
    """num / den in double; NULL when den is 0 or NULL (never throws)."""
    return F.try_divide(dbl(num), F.nullif(dbl(den), F.lit(0.0)))


def days_until(day, as_of) -> Column:
    """DATEDIFF(day, as_of, day): whole days from as_of to day."""
    return F.datediff(col_or(day), lit_date(as_of) if not isinstance(as_of, Column) else as_of)


def expiry_status(days: Column) -> Column:
    # Fixed values: <=1 day critical, <=3 days warning, else ok.
    return (F.when(days <= 1, "critical").when(days <= 3, "warning").otherwise("ok"))


def stock_status(qty: Column, min_qty: Column) -> Column:
    # Fixed values: <=0 out_of_stock, <=min low_stock, else in_stock.
    return (F.when(qty <= 0, "out_of_stock").when(qty <= min_qty, "low_stock")
            .otherwise("in_stock"))


def status_rank(status: Column) -> Column:
    """Position of a status in the forward order (cancelled = 7)."""
    return F.array_position(F.array(*[F.lit(s) for s in ORDER_STATUSES]), status).cast("int")


def not_cancelled(status: str | Column = "status") -> Column:
    return col_or(status) != "cancelled"


def with_scalars(df, *one_row_frames):
    """Attach the columns of one-row aggregates to every row of ``df``.

    Each one-row frame becomes an uncorrelated scalar subquery
    (``DataFrame.scalar``): Spark runs it once and inlines the value, so
    there is no join (and no nested-loop join) at all.
    """
    out = df
    for i, one in enumerate(one_row_frames):
        tmp = f"__scalar{i}"
        out = out.select("*", one.select(F.struct(*one.columns).alias(tmp)).scalar().alias(tmp))
        out = out.select(*[c for c in out.columns if c != tmp], *[F.col(f"{tmp}.{c}").alias(c) for c in one.columns])
    return out
