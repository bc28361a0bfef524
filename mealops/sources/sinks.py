"""Loads and writes: typed table load, CSV export, receipts, adjustments, upserts.

Parquet has no MERGE: every "update" here reads version n and returns (or
writes to a new path) version n+1; a path being read is never overwritten.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import DOMAIN
from .versions import VersionedTables

BOM = "﻿"


def load_tables(spark: SparkSession, path: str, names=None) -> dict[str, DataFrame]:
    """Typed load of the domain tables stored as ``<path>/<table>.parquet``.

    Each table uses its explicit schema, so missing columns read as NULL and
    the scan prunes unused ones. A table that is not there raises an error
    that names its path; ``names`` asks for fewer tables.
    """
    return {name: spark.read.schema(DOMAIN[name]).parquet(os.path.join(path, f"{name}.parquet"))
            for name in names or DOMAIN}


def write_tables(frames: dict[str, DataFrame], path: str) -> None:
    """Write domain tables as ``<path>/<table>.parquet`` in the types of their schemas.

    Columns outside a table's schema are left out, as ``load_tables`` would.
    """
    for name, df in frames.items():
        types = {f.name: f.dataType for f in DOMAIN[name].fields}
        (df.select(*[F.col(c).cast(types[c]).alias(c) for c in df.columns if c in types])
         .write.mode("overwrite").parquet(os.path.join(path, f"{name}.parquet")))


def table_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows) for a set of frames, one aggregate per table."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows")
             for n, df in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _csv_value(c: str) -> Column:
    v = F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))


def csv_lines(df: DataFrame, with_header: bool = True) -> DataFrame:
    """CSV text lines: header unquoted, every value quoted, NULL -> "", inner quotes doubled."""
    body = df.select(F.concat_ws(",", *[_csv_value(c) for c in df.columns]).alias("line"))
    if not with_header:
        return body
    header = df.sparkSession.range(1).select(F.lit(",".join(df.columns)).alias("line"))
    return header.unionByName(body)


def export_csv(df: DataFrame, path: str, *, single_file: bool = False) -> bool:
    """Write ``df`` as UTF-8 CSV with a byte-order mark; empty input writes nothing.

    Each part file starts with BOM + header, so every part opens on its own
    (the distributed default). ``single_file=True`` funnels all rows through
    one task and is meant for small downloads only.
    """
    if df.isEmpty():
        return False
    lines = csv_lines(df, with_header=False)
    if single_file:
        lines = lines.coalesce(1)
    # The low 33 bits of the generated id number the rows of a partition: row 0 carries the header.
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    header = F.lit(BOM + ",".join(df.columns) + "\n")
    lines.select(F.when(first, F.concat(header, F.col("line"))).otherwise(F.col("line")).alias("line")) \
        .write.mode("overwrite").text(path)
    return True


def receipt_rows(receipts: DataFrame, *, as_of, id_offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """Bulk goods receipt -> (new inventory rows, one ``import`` log row each).

    Rows need a name, a positive quantity and an expiry date; others are
    skipped. ``quantity_after`` of the log equals the received quantity.
    """
    ok = receipts.filter(F.col("name").isNotNull() & (F.col("quantity") > 0) & F.col("expiry_date").isNotNull())
    now = F.lit(str(as_of)).cast("timestamp_ntz")
    inv = ok.select(
        (F.col("receipt_id") + F.lit(id_offset)).alias("inventory_id"),
        F.concat(F.lit("RC-"), F.col("receipt_id").cast("string")).alias("inventory_code"),
        "supplier_id", "name", F.col("quantity").cast("decimal(10,2)").alias("quantity"),
        F.col("unit_price").cast("decimal(18,2)").alias("unit_price"),
        F.to_date(now).alias("import_date"), "expiry_date", now.alias("updated_at"))
    logs = inv.select("inventory_id", F.lit("import").alias("action_type"),
                      F.col("quantity").alias("quantity_change"), F.col("quantity").alias("quantity_after"),
                      F.lit("goods receipt").alias("reason"), now.alias("created_at"))
    return inv, logs


def append_receipts(receipts: DataFrame, inventory_path: str, logs_path: str, *, as_of,
                    id_offset: int = 0) -> int:
    """Append the receipt rows to both tables from one materialised frame."""
    inv, _ = receipt_rows(receipts, as_of=as_of, id_offset=id_offset)
    inv = inv.persist()
    try:
        inv.write.mode("append").parquet(inventory_path)
        logs = inv.select("inventory_id", F.lit("import").alias("action_type"),
                          F.col("quantity").alias("quantity_change"), F.col("quantity").alias("quantity_after"),
                          F.lit("goods receipt").alias("reason"), F.col("updated_at").alias("created_at"))
        logs.write.mode("append").parquet(logs_path)
        return inv.count()
    finally:
        inv.unpersist()


def commit_receipts(store: VersionedTables, receipts: DataFrame, *, batch_id: str, as_of, id_offset: int = 0) -> int:
    """Receipts and their log rows as one commit (both or neither); a batch id counts once. Returns the version."""
    inv, logs = receipt_rows(receipts, as_of=as_of, id_offset=id_offset)
    return store.commit(batch_id, append={"inventory": inv, "inventory_logs": logs})


def commit_adjustments(store: VersionedTables, adjustments: DataFrame, *, batch_id: str, as_of) -> int:
    """The stored inventory with new quantities, and the ``adjust`` log rows, as one commit. Returns the version."""
    base = store.version()
    current = store.read("inventory", base)
    new, logs = apply_stock_adjustments(current, adjustments, as_of=as_of)
    changed = new.select("inventory_id", F.col("quantity").alias("_q"), F.col("updated_at").alias("_at"))
    types = {f.name: f.dataType for f in current.schema.fields}
    inv = current.join(changed, "inventory_id").select(*[
        F.col("_q").cast(types[c]).alias(c) if c == "quantity" else F.coalesce("_at", c).alias(c) if c == "updated_at"
        else F.col(c) for c in current.columns])
    return store.commit(batch_id, append={"inventory_logs": logs}, replace={"inventory": inv}, base=base)


def commit_dimension(store: VersionedTables, table: str, feed: DataFrame, *, batch_id: str, **merge) -> int:
    """``merge_dimension`` of a feed into a stored table; the table and its rejects as one commit."""
    base = store.version()
    merged, rejects = merge_dimension(store.read(table, base), feed, **merge)
    return store.commit(batch_id, append={f"{table}_rejects": rejects}, replace={table: merged}, base=base)


def apply_stock_adjustments(inventory: DataFrame, adjustments: DataFrame, *, as_of) -> tuple[DataFrame, DataFrame]:
    """Set quantities by inventory_code; the last adjustment per code wins.

    ``adjustments``: (event_id, inventory_code, quantity, reason, ts).
    Returns (inventory with new quantity and updated_at, ``adjust`` log rows).
    The log records the signed change, which the reference omits.
    """
    now = F.lit(str(as_of)).cast("timestamp_ntz")
    last = adjustments.groupBy("inventory_code").agg(
        F.max_by(F.struct("quantity", "reason"), F.struct("ts", "event_id")).alias("a"))
    j = inventory.join(last, "inventory_code", "left")
    hit = F.col("a").isNotNull()
    new_q = F.when(hit, F.col("a.quantity").cast("decimal(10,2)")).otherwise(F.col("quantity"))
    inv = j.select("inventory_id", "inventory_code", new_q.alias("quantity"),
                   F.when(hit, now).alias("updated_at"))
    logs = j.filter(hit).select("inventory_id", F.lit("adjust").alias("action_type"),
                                (F.col("a.quantity").cast("decimal(10,2)") - F.col("quantity")).alias("quantity_change"),
                                F.col("a.quantity").cast("decimal(10,2)").alias("quantity_after"),
                                F.col("a.reason").alias("reason"), now.alias("created_at"))
    return inv, logs


def merge_dimension(current: DataFrame, feed: DataFrame, *, key: str, required: list[str],
                    order: list[str], defaults: dict | None = None, upper_key: bool = False,
                    reject_duplicate_new: bool = False) -> tuple[DataFrame, DataFrame]:
    """Bulk upsert of a dimension feed -> (merged, rejects).

    The last valid feed row per key (by ``order``) wins. Updates keep the
    current value where the feed has NULL; inserts fill NULLs from
    ``defaults``. Rejects: rows missing the key or a required column, and (optionally)
    repeated rows of a key that is new, except the last.
    """
    defaults = defaults or {}
    f = feed.withColumn(key, F.upper(F.trim(F.col(key)))) if upper_key else feed
    required = list(dict.fromkeys([key, *required]))     # a row without its key is always rejected
    missing = None
    for c in required:
        cond = F.col(c).isNull()
        missing = cond if missing is None else (missing | cond)
    reason = F.lit(None).cast("string")
    for c in reversed(required):
        reason = F.when(F.col(c).isNull(), F.lit(f"missing {c}")).otherwise(reason)
    bad = f.filter(missing).withColumn("reason", reason)
    good = f.filter(~missing)
    value_cols = [c for c in current.columns if c != key and c in feed.columns]
    pos = F.struct(*[F.col(c) for c in order])
    latest = good.groupBy(key).agg(F.max_by(F.struct(*value_cols), pos).alias("_f"), F.count(F.lit(1)).alias("_n"))
    cur = current.withColumn("_cur", F.lit(True))
    j = cur.join(latest, key, "full_outer")
    out = [F.col(key)]
    for c in current.columns:
        if c == key:
            continue
        if c in value_cols:
            d = defaults.get(c)
            ins = F.coalesce(F.col(f"_f.{c}"), F.lit(d)) if d is not None else F.col(f"_f.{c}")
            out.append(F.when(F.col("_cur").isNull(), ins)
                       .otherwise(F.coalesce(F.col(f"_f.{c}"), F.col(c))).alias(c))
        else:
            d = defaults.get(c)
            out.append((F.coalesce(F.col(c), F.lit(d)) if d is not None else F.col(c)).alias(c))
    merged = j.select(*out)
    rejects = bad.select(*feed.columns, "reason")
    if reject_duplicate_new:
        new_keys = latest.filter(F.col("_n") > 1).join(current.select(key), key, "left_anti").select(key, "_f")
        # Rows of a new key other than its last one, told apart by their place in the feed.
        place = good.groupBy(key).agg(F.max(pos).alias("_last"))
        dup = (good.join(new_keys.select(key), key).join(place, key).filter(pos != F.col("_last"))
               .select(*feed.columns).withColumn("reason", F.lit("duplicate new key")))
        rejects = rejects.unionByName(dup)
    return merged, rejects
